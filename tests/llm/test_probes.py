"""Faults that were found once: odd end tags, pages made to be slow, ids that repeat, clashing names, Python behind native work."""

import time

import pytest
from pyspark.sql import functions as F

from vegaflow.llm import language_id, main_text, suffix_dedup, toxicity, url_filter
from vegaflow.llm.queries import URL_RULES

EVERY_RULE = [*(url_filter.host_rule(*r) for r in URL_RULES), *url_filter.DEFAULT_RULES]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>A<script>x</script foo><p>B", "A B"), ("<p>A<script>x</SCRIPT\n><p>B", "A B"), ("<p>A<style>x</style/><p>B", "A B"), ("<p>A<script>x</scripted><p>B</script><p>C", "A C"),
        ("<p>A<img alt='a > b'><p>B", "A B"), ("<p>A<b title=\"<p>\">B</b>", "AB"), ("<p>A<b 'x>B<p>C", "A<b 'x>B C"), ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p>A<!-- <p>B", "A"), ("<p>A<br/>B", "A B"),
    ],
)
def test_tags_as_a_reader_sees_them(page, text):
    assert " ".join(b.text for b in main_text.blocks_of(page)) == text


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<p>x</q>", "</div>", "<a<a", "<a '", "<a \">\" ", "<!-", "<script>x", "<div class=a{i}>x", "<svg><b>", "<li>x", "<!-- x ", "<x y='>'\""])
def test_a_megabyte_of_anything_is_quick(unit):
    page = "".join(unit.replace("{i}", "".join(chr(97 + int(d)) for d in str(i))) for i in range((1 << 20) // len(unit)))
    began = time.process_time()
    main_text.features_of(main_text.blocks_of(page)[:1000])
    assert time.process_time() - began < 8


def test_rules_are_made_by_spark(spark, sf):
    plan = url_filter.rule_table(spark, EVERY_RULE)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan
    rows = {(r["rank"], r["name"], r["action"], r["pattern"], tuple(r["tokens"])) for r in url_filter.rule_table(spark, EVERY_RULE).collect()}
    assert rows == {(r.rank, r.name, r.action, r.pattern, tuple(r.tokens)) for r in EVERY_RULE}


def test_an_id_that_repeats_is_learnt_from_once(spark, monkeypatch):
    docs = spark.range(3000).select((F.col("id") % 12).alias("doc_id"), F.lit("some text of words").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id bigint, toxic int")
    confirmed, unlabelled, _ = toxicity.training_words(docs, labels)
    assert 0 < len(list(confirmed)) <= 12 and 0 < len(list(unlabelled)) <= 12
    assert 0 < len(language_id.training_words(docs)["en"]) <= 12
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("<main><p>Some words of it.</main>").alias("html"))
    seen = []
    monkeypatch.setattr(main_text, "fit", lambda labelled: seen.append(len(labelled)))
    main_text.train(pages)
    assert 700 < seen[0] <= 712


def test_repeats_are_cut_beside_columns_of_any_name(spark):
    body = "a passage of well over fifty bytes that two documents have in common"
    docs = spark.createDataFrame([(1, body + " one", 1, 2, 3, 4), (2, "two " + body, 1, 2, 3, 4)], "doc_id bigint, text string, _doc int, _mark int, _ranges int, __doc int")
    cut = suffix_dedup.without_repeats(spark, docs)
    assert cut.columns == docs.columns and [r["text"] for r in cut.orderBy("doc_id").collect()] == [body + " one", "two "]
