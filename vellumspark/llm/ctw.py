"""Context-tree weighting over bytes: counts, mixing and code lengths on arrays.

Every byte is eight binary decisions, one node for each prefix of its bits; every
(context, node) has counts of zeros and ones and a Krichevsky-Trofimov estimate.
A node of depth d weighs its own estimate and the product of its children (one
more byte of context) evenly, down to ``depth`` bytes:

    Pw = Pe at the full depth, else (Pe + product of the children's Pw) / 2.

The probability of a bit after training mixes the estimates of all depths along
the context, from the deepest up, with beta = Pe / product of the children's Pw:

    p_d = (beta_d * kt_d + p_(d+1)) / (beta_d + 1).

A gram is the context's bytes, newest first, then the byte itself, packed into an
unsigned 64-bit number, so that sorted grams keep subtrees together.  A node is the
context's bytes and the bits so far.  Grams that share their ``cutoff(depth)``
newest bytes are mixed together, at most 256**3 of them at depth 6 however large the
corpus; the levels above are mixed from sums, by ``Levels``.  Texts begin after ``depth`` bytes START and end with one
byte END; neither occurs in UTF-8.
"""

from __future__ import annotations

import numpy as np

START, END = 0xFE, 0xFF
EIGHT = np.uint64(8)


def cutoff(depth: int) -> int:
    """The level down to which grams are mixed together."""
    return min(4, depth)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x >= 8, by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


class _Table:
    """ln gamma(n + offset) - ln gamma(offset) for whole n >= 0."""

    def __init__(self, offset: float, size: int = 4096):
        self.offset, self.size = offset, size
        self.low = np.concatenate(([0.0], np.cumsum(np.log(np.arange(size - 1) + offset))))
        self.gap = self.low[-1] - _log_gamma(np.array([size - 1 + offset]))[0]

    def __call__(self, n: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(n, self.size - 1).astype(np.int64)]
        large = n >= self.size
        if large.any():
            out[large] = _log_gamma(n[large] + self.offset) + self.gap
        return out


_HALF, _ONE = _Table(0.5), _Table(1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones (whole numbers)."""
    return _HALF(a) + _HALF(b) - _ONE(a + b)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _beta(a, b, below):
    return np.exp(np.clip(log_kt(a, b) - below, -700, 700))


def lay_out(texts: list[bytes], depth: int) -> np.ndarray:
    """The texts, each after ``depth`` bytes START and before an END, as one array of bytes."""
    head, end = bytes([START]) * depth, bytes([END])
    return np.frombuffer(b"".join([x for t in texts for x in (head, t, end)]), np.uint8)


def gram_keys(data: np.ndarray, depth: int) -> np.ndarray:
    """Grams of all bytes and ends of texts that are laid out, in order."""
    n = len(data) - depth
    if n <= 0:
        return np.zeros(0, np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in (*range(depth - 1, -1, -1), depth):
        keys <<= EIGHT
        keys |= data[j : j + n]
    return keys[data[depth:] != START]


def parent(nodes: np.ndarray, j: int) -> np.ndarray:
    """Nodes for bit j without their oldest context byte."""
    return ((nodes >> np.uint64(8 + j)) << np.uint64(j)) | (nodes & _mask(j))


def bit_chain(keys: np.ndarray, counts: np.ndarray, depth: int, j: int):
    """Levels depth to the cutoff for bit j: index of each key's deepest node, its bit, p(0) there, and the nodes at the cutoff (key, path to them, a, b, ln Pw).

    Keys are sorted and distinct; all that share their newest cutoff(depth) context bytes must be given together.
    """
    shifted = keys >> np.uint64(8 - j)  # keys are sorted, so these are
    first = np.diff(shifted, prepend=~shifted[:1]) != 0
    nodes, at = shifted[first], np.cumsum(first) - 1
    one = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
    a = np.bincount(at, np.where(one, 0.0, counts), len(nodes))
    b = np.bincount(at, np.where(one, counts, 0.0), len(nodes))
    log_w, p, path = log_kt(a, b), (a + 0.5) / (a + b + 1), np.arange(len(nodes))
    for _ in range(depth - cutoff(depth)):
        nodes, up = np.unique(parent(nodes, j), return_inverse=True)
        a, b, below = (np.bincount(up, x, len(nodes)) for x in (a, b, log_w))
        path = up[path]
        beta = _beta(a, b, below)
        p = (beta[path] * ((a + 0.5) / (a + b + 1))[path] + p) / (beta[path] + 1)
        log_w = np.logaddexp(log_kt(a, b), below) - np.log(2)
    return at, one, p, nodes, path, a, b, log_w


def top_rows(keys: np.ndarray, counts: np.ndarray, depth: int):
    """(node << 3 | bit number, a, b, ln Pw) per node of level cutoff(depth) - 1, summed over the given nodes below; by bit, then sorted."""
    out = []
    for j in range(8):
        *_, nodes, _, a, b, log_w = bit_chain(keys, counts, depth, j)
        up, at = np.unique(parent(nodes, j), return_inverse=True)
        out.append(((up << np.uint64(3)) | np.uint64(j), *(np.bincount(at, v, len(up)) for v in (a, b, log_w))))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


class Levels:
    """The nodes of levels ``high`` to ``low``, from sums over the nodes below for each node of level ``high``."""

    def __init__(self, node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray, high: int, low: int):
        """node: node << 3 | bit number."""
        self.high, self.low, self.levels, above = high, low, {}, []
        for j in range(8):
            mine = (node & np.uint64(7)) == j
            keys, x, y, s = node[mine] >> np.uint64(3), a[mine], b[mine], below[mine]
            order = np.argsort(keys)
            keys, x, y, s = keys[order], x[order], y[order], s[order]
            for level in range(high, low - 1, -1):
                self.levels[j, level] = keys, _beta(x, y, s), (x + 0.5) / (x + y + 1)
                if level:
                    log_w = np.logaddexp(log_kt(x, y), s) - np.log(2)
                    keys, up = np.unique(parent(keys, j), return_inverse=True)
                    x, y, s = (np.bincount(up, v, len(keys)) for v in (x, y, log_w))
            above.append(((keys << np.uint64(3)) | np.uint64(j), x, y, s))
        #: the same sums for the nodes of level low - 1
        self.above = [np.concatenate(c) for c in zip(*above, strict=True)]

    def mix(self, j: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(m, c, parents): where p is p(0) below the given nodes of level high, it is m * p + c at level low; and their nodes at level low - 1."""
        m, c = np.ones(len(nodes)), np.zeros(len(nodes))
        for level in range(self.high, self.low - 1, -1):
            keys, beta, own = self.levels[j, level]
            at = np.searchsorted(keys, nodes)
            share = 1 / (beta[at] + 1)
            m, c = m * share, (c + beta[at] * own[at]) * share
            nodes = parent(nodes, j)
        return m, c, nodes


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, depth: int, mix) -> np.ndarray:
    """log10 of the probability of each key's byte after its context. mix(j, nodes): m and c to the root for nodes of level cutoff(depth) - 1."""
    total = np.zeros(len(keys))
    for j in range(8):
        at, one, p, nodes, path, *_ = bit_chain(keys, counts, depth, j)
        m, c, *_ = mix(j, parent(nodes, j))
        zero = (m[path] * p + c[path])[at]
        total += np.log10(np.where(one, 1 - zero, zero))
    return total


class KeyTable:
    """Values by distinct unsigned 64-bit keys: an open-addressing hash table with array look-ups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(3 * len(keys)).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.append(keys, np.uint64(0)), np.append(values, 0)
        self.slots = np.full(1 << bits, len(keys), np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[slot] == len(keys)
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.wrap

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are in the table."""
        slot = self._slot(keys)
        at = self.slots[slot]
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.wrap
            at[wrong] = self.slots[slot[wrong]]
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]
