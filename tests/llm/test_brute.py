"""Operators against plain single-machine versions, on whole texts and on hand-labelled pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vegaflow.llm import decontamination, language_id, main_text, near_duplicates, pivot_index, toxicity, url_filter
from vegaflow.llm.common import held_out, table


def least_distance(item: str, text: str) -> int:
    """Least edit distance of the item to any part of the text, a whole row of the table at a time."""
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    best, row = len(item), np.zeros(len(chars) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1)
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return min(best, int(row.min()))


def test_leaks_against_whole_text_distances(spark, sf):
    """Every document and item, with edited passages planted; the distances are those of the full table."""
    rng = np.random.default_rng(4)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").orderBy("item_id").limit(12).collect()]
    texts = [r["text"] for r in table(spark, sf, "documents").orderBy("doc_id").limit(30).collect()]
    rows = []
    for i, t in enumerate(texts):
        passage = list(decontamination.normalise(items[i % 12][1]))
        for at in rng.integers(0, len(passage), int(rng.integers(0, len(passage) // 8))):
            passage[at] = rng.choice(["", "q", passage[at] + "z"])
        rows.append((i, t[:1500] + " " + "".join(passage) + " " + t[1500:3000] if i % 3 else t[:3000]))
    found = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {}
    for i, t in rows:
        for x, item in items:
            item = decontamination.normalise(item)
            d = least_distance(item, decontamination.normalise(t))
            if d <= decontamination.budget(item, 0.08):
                want[i, x] = d
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in found} == want and {0} < set(want.values())


@pytest.mark.parametrize(
    ("item", "text", "hit"),
    [("quick brown fox", "A Quick, brown FOX!", True), ("quick brown fox", "a quick brown foxes", False), ("quick brown fox", "a quack brown fox", False), ("fox", "the fox", True), ("fox", "foxes of a firefox", False), ("東京は首都", "日本の東京は首都です", True), ("", "anything", False), ("...", "a ... b", False)],
)
def test_short_items_are_found_as_whole_words(spark, item, text, hit):
    items = [(1, decontamination.normalise(item))] if decontamination.normalise(item) else []
    m = decontamination.Matcher([*items, (2, "an item that is nowhere in any of the texts")], 0.08)
    assert bool(m.matches(text)) == hit == bool(m.matches(text, first_only=True))


def test_short_and_null_items_by_spark(spark):
    docs = spark.createDataFrame([(1, "hold quick brown fox here"), (None, "quick brown fox"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "quick brown fox"), (2, None), (3, " ")], "item_id bigint, text string")
    assert sorted(decontamination.find_leaks(docs, bench).select("doc_id", "item_id").collect(), key=str) == [(1, None), (None, None)]
    assert [r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()] == [3]


def test_toxic_rows_held_out_of_learning_are_found(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    r = toxicity.toxicity(docs, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    toxic, clean = r[r.toxic == 1], r[r.toxic == 0]
    assert len(toxic) > 100 and (toxic.predicted == 1).mean() > 0.75 and (clean.predicted == 0).mean() > 0.99


def test_texts_without_letters_have_no_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    odd = [(-1, "½ ²"), (-2, "Ⅷ 123 ٣"), (-3, "_ - _"), (-4, "2nd ½cup of the tea"), (-5, None)]
    r = {x["doc_id"]: x["lang_pred"] for x in language_id.language_id(docs.unionAll(spark.createDataFrame([(*x, None) for x in odd], docs.schema))).where("doc_id < 0").collect()}
    assert r[-1] == r[-2] == r[-3] == r[-5] == "und" and r[-4] != "und"
    assert language_id.words_of("ab½cd x2y Ⅷ") == ["ab", "cd", "x", "y"]


def test_chains_are_drawn_from_the_whole_text():
    words = [str(i) for i in range(10_000)]
    got = language_id.chains_over(words)
    assert len(got) == language_id.MAX_CHAINS * language_id.CHAIN and got[0] == "0" and got[-1] == "9999"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>A<button>Play<p>B</article>", "A B"), ("<p>A</p><svg/><p>B</p>", "A B"), ("<p>A</p><object data=x /><p>B</p>", "A B"), ("<p>A<iframe src=x /><p>B", "A B"), ("<p>A<iframe src=x><p>B", "A B"),
        ("<p>A<select><option>x<option>y</select><p>C", "A C"), ("<div><select><option>x<option>y<p>Z</div>", "Z"), ("<p>A<script>if (a<b) '</p>'</script><p>D<style>x{}", "A D"), ("<p>A<noscript><p>no</noscript><p>B<textarea>q<p></textarea>", "A B"), ("<title>t</title><p>A<!-- <p>x --><p>B<template><p>t</template>", "A B"),
    ],
)
def test_an_unclosed_element_swallows_nothing(page, text):
    assert " ".join(b.text for b in main_text.blocks_of(page)) == text


#: Hand-written pages in layouts that the builder does not make, with the text a reader would call the article.
PAGES = [
    ("""<!doctype html><html><head><title>Bread</title></head><body><div id="masthead"><a href="/">Daily Oven</a> <a href="/r">Recipes</a></div>
        <div id="wrapper"><article class="recipe"><h1>Sourdough for beginners</h1><p>Feed the starter the night before and keep it somewhere warm.</p><h2>Method</h2><ol><li>Mix flour and water, then rest the dough for an hour.</li><li>Add salt and fold every thirty minutes.</li></ol><blockquote>Patience is the only secret.</blockquote></article></div>
        <section id="comments" class="comments"><h3>3 comments</h3><p>My loaf came out flat, what did I do wrong?</p></section><footer><p>Copyright 2021 Daily Oven. All rights reserved.</p></footer></body></html>""",
     ["Sourdough for beginners", "Feed the starter the night before and keep it somewhere warm.", "Method", "Mix flour and water, then rest the dough for an hour.", "Add salt and fold every thirty minutes.", "Patience is the only secret."]),
    ("""<body><header class="site"><nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav></header><div class="cookie-consent"><p>We use cookies to improve your visit.</p><button>OK</button></div>
        <main><article><h1>River levels fall</h1><p>Water in the upper valley fell by a metre &amp; a half this month.<p>Officials say rain is due on Thursday.<aside class="related"><p>Read also: the drought of 1976</p></aside><p>Farmers are not convinced.</article></main>
        <aside class="sidebar"><p>Subscribe to our newsletter for weekly news.</p></aside><script>var x = "<p>no</p>";</script></body>""",
     ["River levels fall", "Water in the upper valley fell by a metre & a half this month.", "Officials say rain is due on Thursday.", "Farmers are not convinced."]),
    ("""<html><body><nav class="breadcrumb"><a href="/">Home</a> <a href="/m">Music</a></nav><main role="main"><h1>The last concert</h1><p>They played for three hours in front of an empty hall.</p><div class="advert"><p>Buy two tickets and get one for free today!</p></div><p>Nobody asked for an encore, and none was given.</p></main>
        <form class="search"><label>Search</label><input name=q></form><div class="footer"><p>Imprint and privacy policy</p></div></body></html>""",
     ["The last concert", "They played for three hours in front of an empty hall.", "Nobody asked for an encore, and none was given."]),
    ("""<body><article><h1>Notes on moss</h1><p>Moss has no roots. It drinks through its leaves.</p><pre>genus   Sphagnum</pre><p>It can hold <b>twenty times</b> its own weight in water.</p></article><div class="share social"><a href=x>Share</a><a href=y>Post</a></div><section class="comment-list"><div class="comment"><p>Lovely photographs, thank you.</p></div></section></body>""",
     ["Notes on moss", "Moss has no roots. It drinks through its leaves.", "genus Sphagnum", "It can hold twenty times its own weight in water."]),
]


def test_hand_labelled_pages(spark, sf):
    model = main_text.train(table(spark, sf, "pages"))
    right = whole = 0
    for page, want in PAGES:
        got = model.text(page).split("\n\n")
        blocks = {b.text for b in main_text.blocks_of(page)}
        assert set(want) <= blocks
        right += sum((b in got) == (b in want) for b in blocks)
        whole += len(blocks)
    assert right / whole >= 0.95


def test_rows_that_share_an_id_have_one_text_and_one_vector(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " more"), (2, "quite another text of some words"), (2, words + " more"), (3, None), (3, words)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [sorted(map(tuple, near_duplicates.near_duplicates(spark, d, 2).collect()), key=str) for d in (df, df.orderBy(F.desc("text")))]
    assert got[0] == got[1] and len(got[0]) == 6 and len({c for i, n, c, _ in got[0] if i == 2}) == 1
    assert (3, 0, 3, True) in got[0] and (3, 59, 1, False) in got[0]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = [sorted(map(tuple, pivot_index.near_vectors(spark, d).collect())) for d in (v, v.orderBy(F.desc("embedding")))]
    assert got[0] == got[1] and sum(n for _, n, *_ in got[0]) == 3  # id 2 links with 1 or with 3, in both of its rows


def test_many_rules_against_brute_force(spark, sf):
    """3,000 rules on all urls and on planted ones, against a scan of all rules."""
    listed = [("allow" if i % 3 else "block", f"h{i % 40}.example.{('com', 'net', 'org')[i % 3]}/{('', 'a/', f'p{i}', f'en/p{i}/')[i % 4]}") for i in range(3000)]
    listed = list(dict((r, a) for a, r in listed).items())
    urls = [r["url"] for r in table(spark, sf, "pages").collect()] + [f"https://{s}H{i}.example.{d}/{p}?q" for i in range(0, 40, 3) for d in ("com", "net") for s in ("", "www.", "x") for p in ("", "a/b", f"p{i}x", f"en/p{i}/z")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = url_filter.rule_table(spark, [url_filter.host_rule(a, r) for r, a in listed])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.partition("://")[2].partition("?")[0].partition("#")[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fits = [(len(r), r, a) for r, a in listed if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
        assert got[i] == (max(fits)[1:] if fits else (None, "allow"))
    assert sum(r is not None for r, _ in got.values()) > 50
