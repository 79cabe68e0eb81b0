"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: each operator has a defined result."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the cat sat on a mat and saw an old dog near the gate of our town while rain fell".split()


def prose(k: int, n: int = 60) -> str:
    return " ".join(WORDS[(i * (k % 7 + 1) + i // 5 + k) % len(WORDS)] for i in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i), ("en", "fr")[i % 2], f"s{i % 3}", 300) for i in range(40)]
    rows += [
        (100, None, "en", "s0", None), (101, "", None, None, 0), (102, "   \n\t ", "en", "s1", 6), (103, "12345 !!!", "fr", "s1", 9), (104, prose(3), "en", "s9", 300),
        (105, prose(5, 60_000), "en", "s2", 300_000), (106, "a", "en", "s2", 1), (106, "a", "en", "s2", 1), (None, prose(8), None, "s0", 300), (107, "x\u0000y\u2028z \U0001f600 é", "en", "s0", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 10 == 0)) for i in range(40)] + [(5, 1, 0), (None, 1, 1), (9999, 0, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


CLASH = ("p_document", "kept", "weight", "size", "key", "block", "n", "h1", "cls", "score", "rejected", "lang_pred", "shard", "bin", "piece", "n_tokens", "media", "ids", "label", "grade", "template", "host", "path", "_h", "_p", "links")


def clashing(df):
    return df.select("*", *[F.lit("other").alias(c) for c in CLASH if c not in df.columns])


def quality(docs, labels):
    from pitframe.llm.quality import quality

    return quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def language(docs, labels):
    from pitframe.llm.langid import fit_language, held_out, predict_language

    return predict_language(docs.select("*"), fit_language(docs.where(~held_out(F.col("doc_id")))))


def packing(docs, labels):
    from pitframe.llm.packing import byte_tokens, pack

    return pack(byte_tokens(docs))


def minhash(docs, labels):
    from pitframe.llm.minhash import near_duplicates

    return near_duplicates(docs)


def media(docs, labels):
    from pitframe.llm.mpegts import probe, store

    return probe(store(docs))


def toxicity(docs, labels):
    from pitframe.llm.toxicity import fit_toxicity, grade

    return grade(docs, fit_toxicity(docs, labels))


def bpe(docs, labels):
    import public_tokenizers

    from pitframe.llm.bpe import digests

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def bits(docs, labels):
    import public_tokenizers

    from pitframe.llm.bitpack import read_documents, write_ids
    from pitframe.llm.common import scratch

    spark = docs.sparkSession
    path = scratch(spark, "ids")
    write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), 50_257, 0, path)
    return read_documents(spark, path)


def tree(docs, labels):
    import public_tokenizers

    from pitframe.llm.treebpe import digests

    return digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def middle(docs, labels):
    from pitframe.llm.skiplist import digests

    return digests(docs)


ALL = [quality, language, packing, minhash, media, toxicity, bpe, bits, tree, middle]


@pytest.mark.parametrize("op", ALL)
def test_every_row_has_a_result(op, docs, labels):
    got = op(docs, labels)
    if op is packing:  # a row per bin: a document's first piece stands for it
        got = got.select(F.explode(F.arrays_zip("doc_ids", "pieces")).alias("x")).where("x.pieces = 0").select("x.doc_ids").withColumnRenamed("doc_ids", "doc_id")
    ids = [r["doc_id"] for r in got.collect()]
    want = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("op", ALL)
def test_clashing_columns_change_nothing(op, docs, labels):
    plain, other = op(docs, labels), op(clashing(docs), clashing(labels))
    names = [c for c in plain.columns if c in ("doc_id", "p_quality", "class_id", "n_links", "payload_sha256", "severity", "ids_sha256", "output_sha256", "start", "capacity", "tokens", "doc_ids")]
    rows = lambda df: sorted(map(repr, df.select(*names).collect()))
    assert rows(plain) == rows(other)


@pytest.mark.parametrize("op", ALL)
def test_empty_tables(op, docs, labels):
    assert op(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("op", [quality, language, toxicity])
def test_no_labels(op, docs, labels):
    bare = docs.withColumn("lang", F.lit(None).cast("string")) if op is language else docs
    got = op(bare, labels.limit(0))
    assert got.count() == docs.count()
    if op is language:
        assert {r["lang_pred"] for r in got.collect()} == {"und"}
    if op is toxicity:
        assert not got.where("toxic").count()


def test_quality_of_nothing_is_nil(docs, labels):
    got = {r["doc_id"]: r for r in quality(docs, labels).collect()}
    for i in (100, 101):
        assert got[i]["p_quality"] == 0 and not got[i]["kept"]
    assert all(0 <= r["p_quality"] <= 1 for r in got.values())


def test_language_of_no_letters_is_undetermined(docs, labels):
    got = {r["doc_id"]: r for r in language(docs, labels).collect()}
    for i in (100, 101, 102, 103):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)


def test_packing_keeps_every_token(docs, labels):
    got = packing(docs, labels).toPandas()
    parts = []
    for r in got.itertuples():
        assert len(r.tokens) == r.n_tokens == r.ends[-1] <= r.capacity and r.capacity == min(c for c in (512, 1024, 2048, 4096) if c >= r.n_tokens)
        parts += [(-1 if d is None or d != d else d, p, s, r.tokens[e0:e1]) for d, p, s, e0, e1 in zip(r.doc_ids, r.pieces, r.starts, [0, *r.ends[:-1]], r.ends)]
    assert all(s == 4096 * p for _, p, s, _ in parts)
    whole, at = [], {}
    for d, p, _, data in sorted(parts, key=lambda x: (x[0], x[1])):
        if p == 0:
            at[d] = len(whole)
            whole.append((d, data))
        else:
            whole[at[d]] = (d, whole[at[d]][1] + data)
    assert sorted(whole) == sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode() + b"\xff") for r in docs.collect())


def test_near_duplicates_of_blank_and_null(docs, labels):
    got = {}
    for r in minhash(docs, labels).collect():
        got.setdefault(r["doc_id"], r)
    for i in (100, 101, 102):
        assert (got[i]["class_id"], got[i]["n_links"], got[i]["kept"]) == (i, 0, True)
    assert got[None]["class_id"] is None and got[None]["n_links"] == 0 and got[None]["kept"]
    assert got[104]["class_id"] == 3 and not got[104]["kept"]
    assert got[106]["n_links"] == 1


def test_keep_one_of_repeated_and_null_ids(spark):
    from pitframe.llm.minhash import keep_one

    rows = [(None, prose(1)), (None, prose(2)), (3, prose(3)), (5, prose(3)), (5, prose(4)), (5, prose(4)), (5, None), (5, ""), (6, prose(5)), (6, prose(6))]
    got = [(r["doc_id"], r["text"]) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([r for i, r in enumerate(rows) if i not in (3, 5)], key=repr)


def test_near_duplicates_compare_each_text_of_a_repeated_id(spark):
    from pitframe.llm.minhash import near_duplicates

    t1, t2 = prose(1), " ".join(f"w{i}" for i in range(60))
    rows = [(1, t1), (1, t2), (2, t2 + " z"), (3, t1 + " z"), (5, "a b c d e f"), (5, "g h i j k l m"), (7, "g h i j k l m")]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 5, 0, True), (5, 5, 1, True), (7, 5, 1, False)]


def test_vectors_of_repeated_ids_and_each_length(spark):
    from pitframe.llm.embeddings import near_vectors

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])] + [(i, [1.0, 0.01 * (i - 9), 0.0]) for i in (10, 11)] + [(20, [0.95, math.sqrt(1 - 0.95**2) + 1e-9]), (21, [])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (3, 1, 1), (4, 1, 1), (10, 1, 10), (11, 1, 10), (20, 0, 20), (21, 0, 21)]


def test_vectors(spark):
    from pitframe.llm.embeddings import near_vectors

    nan, inf = float("nan"), math.inf
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0]), (10, [1.0]), (11, [0.0, 1.0]), (11, [0.0, 1.0]), (None, [1.0, 0.0]), (12, [-1.0, 0.0]), (None, [-1.0, -1.0]), (None, [-2.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in near_vectors(clashing(df)).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(3, 1, True)] and got[2] == [(3, 1, False)] and got[3] == [(3, 1, False)]
    assert got[4] == [(2, 4, True)] and got[11] == [(2, 4, False)] * 2
    for i in (5, 6, 7, 8, 9, 12):
        assert got[i] == [(0, i, True)]
    assert got[10] == [(1, 10, True)] * 2 and sorted(got[None]) == [(1, None, True)] * 2 + [(3, 1, False)]  # without a number, but compared
    assert near_vectors(df.limit(0)).count() == 0


def test_urls(spark):
    from pitframe.llm.urls import judge

    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.org/es/1?x=://a"), (5, "https://a.b.Example.ORG/en/12"), (6, "http://x.org"), (7, "http://x.org/"), (8, "http://y.com/fr/a"), (9, "http://y.com/de/a#f"),
        (10, "a://b://c/d"), (11, "http://z.net?q=/de/"), (11, "http://z.net?q=/de/"), (None, "http://notexample.org/es/1"), (12, "http://" + "h" * 50 + ".net/" + "/".join("abc" * 9) * 30), (13, "http://É.com/de/x\ny"),
    ]
    got = {r["page_id"]: r for r in judge(clashing(spark.createDataFrame(rows, "page_id long, url string"))).collect()}
    for i in (1, 2, 3):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow")
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("example.org", "/es/1", "example.org/es/", "block")
    assert (got[5]["rule"], got[5]["verdict"]) == ("example.org/en/1", "block")
    assert got[6]["rule"] is None and got[7]["rule"] == "org/"
    assert got[8]["verdict"] == "allow" and got[9]["rule"] == "com/de/" and got[9]["path"] == "/de/a"
    assert (got[10]["host"], got[10]["path"]) == ("b:", "//c/d") and (got[11]["host"], got[11]["path"]) == ("z.net", "")
    assert got[None]["rule"] == "org/" and got[13]["host"] == "É.com" and got[13]["path"] == "/de/x\ny"
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
