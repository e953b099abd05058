import uuid

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as t


def one(spark, column, **values):
    fields = ", ".join(f"`{k}` {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("Điều lệ, (của)  Đảng!", ["điều", "lệ", "của", "đảng"]), ("", []), (None, []), ("a_b-c", ["a", "b", "c"])])
def test_tokens(spark, text, want):
    assert one(spark, t.tokens(F.col("x")), x=text) == want


def test_counts_in_any_script(spark):
    assert one(spark, t.word_count(F.col("x")), x="Điều lệ") == 2
    assert one(spark, t.approx_tokens(F.col("x")), x="a b c\n d") == 5


def test_clean_up(spark):
    assert one(spark, t.strip_citations(F.col("x")), x="a[1] b[x][23]") == "a b[x]"
    assert one(spark, t.strip_citations(F.col("x"), False), x="a[cần dẫn nguồn][2]") == "a"
    assert one(spark, t.join_lone_newlines(F.col("x")), x="a\nb\n\nc") == "a. b\n\nc"
    assert one(spark, t.squeeze(F.col("x")), x="  a\t b \n c ") == "a b c"
    assert one(spark, t.clean_spaces(F.col("x")), x=" a b​ \r\nc ") == "a b\nc"
    assert one(spark, t.break_before_markers(F.col("x")), x="end.Điều 2. go CHƯƠNG II") == "end.\nĐiều 2. go \nCHƯƠNG II"
    assert one(spark, t.wiki_clean(F.col("x")), x="One[1]\ntwo\n\nthree\nTham khảo:\nrest") == "One. two three"


@pytest.mark.parametrize("heading", ["== Tham khảo ==", "==Tham khảo==", "# Nguồn", "XEM THÊM"])
def test_footer(spark, heading):
    assert one(spark, t.cut_footer(F.col("x")), x=f"a\n{heading}\nb") == "a"
    assert one(spark, t.cut_footer(F.col("x")), x="a\nxem thêm điều này\nb") == "a\nxem thêm điều này\nb"


def test_flags(spark):
    def flags(x):
        return spark.createDataFrame([(x,)], "x string").select(*[c.alias(n) for n, c in t.content_flags(F.col("x")).items()]).first().asDict()

    assert flags("E = mc²")["has_formula"] and not flags("plain words")["has_formula"]
    assert flags("| a |\n | b |")["has_table"] and not flags("| a |\nb")["has_table"]
    assert flags("- a\n2. b")["has_list"] and not flags("- a")["has_list"]
    assert flags("theo ĐIỀU 12")["has_legal"] and flags("x + 5")["has_math"] and flags("w " * 20)["is_substantial"]


def test_categories_and_domains(spark):
    assert one(spark, t.short_category(F.col("x")), x="Toán_học > Đại_số > Phương_trình") == "Toán-Phương trình"
    assert one(spark, t.short_category(F.col("x")), x="Lịch_sử") == "Lịch sử"
    assert one(spark, t.short_category_sub(F.col("x")), x="Toán_học > Đại_số") == "Toán-Đại số"
    assert one(spark, t.short_category_sub(F.col("x")), x=None) == "Tổng hợp"
    assert one(spark, t.domain(F.col("x")), x="Toán_học > luật") == "stem"
    assert [one(spark, t.domain(F.col("x")), x=v) for v in ("Bộ_luật", "Du_lịch", None)] == ["legal", "general", "general"]
    assert [one(spark, t.first_category(F.col("x")), x=v) for v in (["Toán_học", "b"], [])] == ["Toán học", "Uncategorized"]
    assert one(spark, t.first_category(F.lit(None).cast("array<string>")), x="") == "Uncategorized"


@pytest.mark.parametrize("name", ["a_0", "Điều_1", ""])
def test_uuid5(spark, name):
    assert one(spark, t.uuid5(F.col("x")), x=name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_keep_rules(spark):
    for column, x, want in [(t.keep_chunk_wiki, "năm 1945", True), (t.keep_chunk_wiki, "ngắn", False), (t.keep_chunk_stem, "F = ma", True), (t.keep_chunk_stem, "short", False), (t.keep_chunk_sub, "1/2", True), (t.keep_chunk_sub, "x" * 50, True)]:
        assert one(spark, column(F.col("x")), x=x) is want


def test_syntax(spark):
    assert [one(spark, t.syntax_issues(F.col("x")), x=v) for v in ("Ok.", "ừ", "", "bad.")] == ["OK", "lower-case start, no final mark", "empty", "lower-case start"]
    assert one(spark, t.slug_title(F.col("x")), x="http://a.b/luat-dat-dai/") == "Luat Dat Dai"


def test_chunk_filters_read_every_paragraph(spark, tmp_path):
    from vellumspark.plans.catalog import QUERIES

    rows = [(1, "short\n\nF = ma"), (2, "short\n\n| a |\n| b |"), (3, "short\nnăm 1945"), (4, "short\n\nnăm 1945\n\n" + "x" * 60), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("keep_chunk_stem") == {(1, 1, 6), (2, 1, 11), (4, 2, 60)}
    assert got("keep_chunk_wiki") == {(3, 0, 14), (4, 1, 8), (4, 2, 60)}
    assert got("keep_chunk_sub") >= {(3, 0, 14), (4, 1, 8), (4, 2, 60)}
