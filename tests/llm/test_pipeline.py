import base64
import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from vellumspark.llm.decontaminate import BenchmarkIndex, _match_batch  # noqa: E402

from . import data  # noqa: E402
from .test_classifiers import language_rows  # noqa: E402
from .test_exact_dedup import brute as brute_exact  # noqa: E402
from .test_mixing import check as check_mix  # noqa: E402
from .test_simhash import brute_components, brute_print  # noqa: E402


def corpus():
    rows = language_rows(160)
    rows += [(500 + i, f"{rows[i][1]}  ", rows[i][2], "copy", 0) for i in range(40)]  # exact copies, longer
    rows += [(700, None, "en", "s", 0), (701, "123 !!!", "en", "s", 0), (702, "", "fr", "s", 0)]
    rows += [(800 + i, f"the and {LEAK} with the", "en", "leak", 0) for i in range(3)]
    return rows


LEAK = "tion ing the secret answer of question number seven with all and more words"


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(rows, data.DOCS).repartition(4), benchmark=spark.createDataFrame([(7, LEAK.upper() + ".")], "item_id long, text string"))
    live = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = {r[0] for r in brute_exact(live) if r[3]}
    live = [r for r in live if r[0] in kept]
    low = brute_components([(r[0], brute_print(r[1])) for r in live], lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    live = [r for r, c in zip(live, low, strict=True) if r[0] == c]
    index = BenchmarkIndex([(7, LEAK)], 0.8)
    dirty = {hit[0] for hit in _match_batch(index, [(r[0], r[1]) for r in live])}
    live = [r for r in live if r[0] not in dirty]
    assert not any(r[0] >= 700 for r in live) and len(live) > 100
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    got = got.collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in got)
    assert {r["doc_id"] for r in got} <= {r[0] for r in live} and all(r["taken"] > 0 for r in got)
    missing = [r for r in live if r[0] not in {g["doc_id"] for g in got}]
    sizes = {}
    for r in live:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    fill = [dict(doc_id=r[0], size=len(r[1].split()), source_size=sizes[r[3]], target=next((g["target"] for g in got if g["source_size"] == sizes[r[3]]), 0), taken=0) for r in missing]
    check_mix(live, [g.asDict() for g in got] + fill)


def noise_of(kind, n, rng):
    """About n characters that are in no language, made in other ways than those the model learns from."""
    made = {
        "shuffled": lambda: "".join(rng.sample("the quick words of some text that goes on and on " * 40, n)),
        "csv": lambda: "\n".join(",".join(f"{rng.uniform(-500, 500):.3f}" for _ in range(6)) for _ in range(n // 50 + 1)),
        "log": lambda: "\n".join(f"2024-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T10:{rng.randint(0, 59):02d}:00 {rng.getrandbits(64):016x} {rng.randint(0, 99999)}" for _ in range(n // 45 + 1)),
        "base64": lambda: base64.b64encode(rng.randbytes(n)).decode(),
        "uuid": lambda: "\n".join(str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n // 37 + 1)),
        "code": lambda: "\n".join(f"for (int {rng.choice('ijk')} = {rng.randint(0, 9)}; i < n_{rng.randint(0, 99)}; i++) {{ buf[{rng.randint(0, 64)}] ^= tmp->{rng.choice(['ptr', 'len'])} & 0x{rng.getrandbits(16):x}; }}" for _ in range(n // 80 + 1)),
        "signs": lambda: "".join(rng.choice("#$%&*+-=|/<>[]{}()0123456789 a") for _ in range(n)),
    }
    return made[kind]()


NOISE_KINDS = ["shuffled", "csv", "log", "base64", "uuid", "code", "signs"]


def test_language_stage_rejects_noise_and_keeps_documents(spark):
    rng, clean = random.Random(11), language_rows(240)
    keys = [(5000 + i, f'{r[1]} token = "{rng.getrandbits(160):040x}" {rng.getrandbits(50)}', r[2], "s", 0) for i, r in enumerate(clean[:60])]
    noise = [(9000 + 100 * k + i, noise_of(kind, rng.randint(300, 1500), rng), None, "n", 0) for k, kind in enumerate(NOISE_KINDS) for i in range(30)]
    docs = spark.createDataFrame([*clean, *keys, *noise], data.DOCS)
    kept = {r[0] for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept >= {r[0] for r in [*clean, *keys]}
    for k in range(len(NOISE_KINDS)):
        assert len(kept & set(range(9000 + 100 * k, 9030 + 100 * k))) <= 1, NOISE_KINDS[k]


CLASHING = [*data.CLASH, "_file", "_row", "_score", "_lang_pred", "_none", "doc", "grp", "plan", "pattern", "fp", "no_id"]


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    d = data.write(spark, tmp_path, benchmark=spark.createDataFrame([(1, "nothing like it at all here")], "item_id long, text string"))
    docs = data.clashing(spark).withColumns({c: F.lit("clash") for c in CLASHING})
    docs.write.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, spark.read.parquet(f"{tmp_path}/docs"), docs.limit(0)):
            out = stage(spark, frame, d)
            rows = out.collect()
            if name != "mix_sources":
                assert out.columns == docs.columns
            assert all(r[c] == "clash" for r in rows for c in CLASHING if not (name == "mix_sources" and c in ("size", "taken")))
            if name in ("exact_dedup", "near_dedup"):
                assert len([r for r in rows if r["doc_id"] == 9]) <= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix_sources"]
    assert re.match("^[a-z_]+$", corpus_pipeline.STAGES[0][0])


def test_language_stage_rejects_texts_in_no_language(spark, tmp_path):
    rng = random.Random(6)
    rows = language_rows(600)
    junk = [(2000 + i, "".join(rng.sample(rows[i][1], len(rows[i][1]))), "en", "s", 0) for i in range(60) if len(rows[i][1]) > 60]
    junk += [(3000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=300)), "fr", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows + [(*r[:2], None, *r[3:]) for r in junk], data.DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert kept >= {r[0] for r in rows}
    assert len(kept & {r[0] for r in junk}) <= 0.1 * len(junk)


def test_near_dedup_without_ids(spark, tmp_path):
    rows = [(None, "alpha beta gamma delta", "en", "a", 0)] * 3 + [(None, "quite another text of words", "en", "a", 0), (4, "a third text that has an id", "en", "a", 0)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, data.DOCS), str(tmp_path)).collect()
    assert sorted(r["text"] for r in kept) == sorted({r[1] for r in rows})


def test_folders_are_deleted(spark, tmp_path):
    d = data.write(spark, tmp_path, documents=spark.createDataFrame(language_rows(40), data.DOCS), benchmark=spark.createDataFrame([(1, "not there at all")], "item_id long, text string"))
    (file,) = {f.rsplit("/", 2)[0] for f in corpus_pipeline.run(spark, d).inputFiles()}
    assert os.listdir(file.removeprefix("file://")) == ["mix_sources"]
