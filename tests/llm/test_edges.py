"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vegaflow.llm import decontamination, language_id, main_text, near_duplicates, packing, pivot_index, suffix_dedup, token_counts, toxicity, url_filter
from vegaflow.llm.queries import URL_RULES, byte_encoder, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, hash string, n int, rep int, ranges string, _host string, body string"
LONG = "the long text of many words goes on and on. " * 4000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "the cat sat on the mat and looked at the dog that sat there"),
    (6, "the cat sat on the mat and looked at the dog that sat there"), (7, LONG), (8, LONG + "end"), (None, "no id here"), (9, "tie tie tie"), (9, "tie tie tie"), (10, "ünïcödé wörds 日本語 \u0000 x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 4 else "en", None, len(t) if t else None, "k", "h", 1, 2, "r", "host", "b") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (7, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (4, "short")], "item_id bigint, text string")


def test_token_counts(spark, docs, empty):
    model = tokenizer_path("piece_bpe_32k.model")
    r = token_counts.count_tokens(spark, docs, model).collect()
    assert len(r) == len(ROWS)
    by = {x["doc_id"]: x for x in r}
    assert (by[1]["n_bytes"], by[1]["n_tokens"]) == (0, 0) and by[2]["n_tokens"] == 0 and by[7]["over_limit"]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert all(by[i]["n_tokens"] == len(sp.encode(t or "")) for i, t in ROWS)
    assert token_counts.count_tokens(spark, empty, model).count() == 0


def test_packing(spark, docs, empty):
    p = packing.pack(spark, docs, byte_encoder())
    r = p.collect()
    assert {x["doc_id"] for x in r} == {i for i, _ in ROWS}
    assert sum(x["length"] for x in r if x["doc_id"] == 1) == 1
    by: dict = {}
    for x in r:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack(spark, empty, byte_encoder()).count() == 0


def test_near_duplicates(spark, docs, empty):
    r = near_duplicates.near_duplicates(spark, docs, 2).collect()
    assert len(r) == len(ROWS)
    by = {x["doc_id"]: x for x in r}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[4]["n_shingles"] == 1
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[8]["component_id"] == 7
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_duplicates.near_duplicates(spark, empty).count() == 0


def test_near_duplicates_shuffle_few_texts_in_vain(spark):
    docs = spark.range(-20000, 20000).selectExpr("id as doc_id", "'t' as text")
    ids = docs.where("doc_id % 10 = 0").select("doc_id")
    found = {r[0] for r in near_duplicates.maybe_among(docs, ids).select("doc_id").collect()}
    assert {r[0] for r in ids.collect()} <= found and len(found) < 4000 + 0.05 * 36000
    assert near_duplicates.maybe_among(docs, ids.where("false")).count() == 0


def test_suffix_dedup(spark, docs, empty):
    r = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(spark, docs).collect()}
    assert r[1]["n_bytes"] == 0 and r[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert r[5]["n_removed"] == 0 and r[6]["n_removed"] == r[6]["n_bytes"] and r[6]["n_spans"] == 1
    assert r[8]["n_removed"] == len(LONG) and r[7]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(spark, empty).count() == 0
    cut = suffix_dedup.without_repeats(spark, docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert cut.where("doc_id = 8").first()["text"] == "end"


def test_suffix_dedup_short_texts_of_a_shared_id(spark):
    body = "a passage of well over fifty bytes that two documents have in common"
    rows = [(1, body), (5, "x" + body), (5, "short"), (5, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark, df).where("doc_id = 5").collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(len(body) + 1, len(body), 1, sha("x")), (5, 0, 0, sha("short")), (0, 0, 0, sha("")), (0, 0, 0, sha(""))])
    assert sorted((r["text"] or "" for r in suffix_dedup.without_repeats(spark, df).where("doc_id = 5").collect())) == ["", "", "short", "x"]


def test_suffix_dedup_deals_batches_in_any_order(spark):
    body = "the same fifty or more bytes around one hot anchor, in two documents"
    hashes = spark.createDataFrame([(7, 20, 0, 0, 20, body.encode(), len(body)), (7, 10, 0, 0, 20, body.encode(), len(body))], suffix_dedup.CONTEXT).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        dealt = suffix_dedup.dealt_anew(hashes, suffix_dedup.DEPTH, suffix_dedup.GRAM).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a context goes without its body only where a smaller document has sent it
    assert dealt and all(r["body"] is not None for r in dealt if r["doc_id"] == 10)


def test_decontamination(docs, empty, bench, spark):
    r = decontamination.find_leaks(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"], x["distance"]) for x in r} == {(5, 1, 0), (6, 1, 0)}
    assert decontamination.without_leaks(docs, bench).count() == len(ROWS) - 2
    assert decontamination.find_leaks(empty, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.where("false")).count() == 0


def test_toxicity(docs, empty, labels):
    assert toxicity.toxicity(docs, labels).count() == len(ROWS)
    assert toxicity.toxicity(docs, labels.where("false")).where("score between 0 and 1").count() == len(ROWS)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_language_id(docs, empty):
    r = {x["doc_id"]: x for x in language_id.language_id(docs).collect()}
    assert r[1]["lang_pred"] == r[2]["lang_pred"] == r[3]["lang_pred"] == "und" and r[1]["score"] == 0
    assert r[5]["lang_pred"] == "en"
    assert language_id.language_id(empty).count() == 0
    assert {x["lang_pred"] for x in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "nourl", "plain text only"), (4, "HTTP://WWW.Example.com/en/x?y#z", "<article><p>A &amp; B<p>C\n D</article>"), (4, "http://a.net/fr/1", "<div"), (5, "http://casino.org", "<script>x</script>"), (None, "https://example.com", "<article><p>x" + " y" * 50000)]
    pages = spark.createDataFrame([(*r, "t", "r") for r in rows], "page_id bigint, url string, html string, text string, rule string")
    r = main_text.main_text(pages).collect()
    assert len(r) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in r)
    assert [x["text"] for x in r][:2] == ["", ""] and [x["text"] for x in r][3] == "A & B\n\nC D"
    assert main_text.main_text(pages.where("false")).count() == 0
    rules = url_filter.rule_table(spark, [*(url_filter.host_rule(*r) for r in URL_RULES), *url_filter.DEFAULT_RULES])
    u = url_filter.filter_urls(pages, rules).collect()
    assert sorted(((x["host"], x["path"], x["rule"], x["verdict"]) for x in u), key=str) == sorted([
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.net", "/fr/1", "net/fr/", "block"), ("casino.org", "", None, "block"), ("example.com", "", None, "allow"),
    ], key=str)
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0
    assert {x["verdict"] for x in url_filter.filter_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.01]), (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [])]
    v = spark.createDataFrame([(i, x, 0, 1, 2) for i, x in rows], "vec_id bigint, embedding array<double>, label int, id int, rep int")
    r = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in pivot_index.near_vectors(spark, v).collect()}
    assert r[1] == (3, 1, True) and r[2] == (3, 1, False) and r[7] == (3, 1, False) and r[10] == (3, 1, False)
    assert all(r[i] == (0, i, True) for i in (3, 4, 5, 6, 8, 9, 11)) and r[None] == (0, None, True)
    assert pivot_index.near_vectors(spark, v.where("false")).count() == 0
