"""Operators against brute force, round trips and held-out rows."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vegaflow.llm import decontamination, language_id, main_text, near_duplicates, packing, pivot_index, suffix_dedup, token_counts, toxicity
from vegaflow.llm.common import held_out, table
from vegaflow.llm.queries import byte_encoder, tokenizer_path

TEXT = st.text(alphabet="ab c▁\n.<s>é日 '", max_size=60)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_piece_counts_equal_the_library(text):
    c = token_counts.Pieces(tokenizer_path("piece_bpe_32k.model"))
    assert c.parts_at_marks() and sum(c.of(token_counts.pre_tokens(text))) == len(c.model.encode(text))


def test_rare_words_are_joined_by_shuffle(spark, sf, monkeypatch):
    """With a broadcast table of 20 words, all others are counted by the join; sums equal the library's."""
    monkeypatch.setattr(token_counts, "HEAD", 20)
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.unionAll(docs.limit(5)).unionAll(spark.createDataFrame([(None, "x" * 300), (7, None)], docs.schema))
    model = token_counts.Pieces(path).model
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.count_tokens(spark, docs, path).collect())
    assert got == sorted((r["doc_id"] or -1, len(model.encode(r["text"] or ""))) for r in docs.collect())


def test_ids_equal_the_tokenizers_library(spark, sf):
    e = packing.Encoder.of(*byte_encoder())
    every = "".join(f" {chr(i)}a{chr(i)}" for i in range(1, 0x250)) + " <|endoftext|>"
    texts = [r["text"] for r in table(spark, sf, "documents").select("text").collect()] + [every, every.replace("<|endoftext|>", "")]
    assert all(e.ids(t) == e.whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_nnls_uses_no_length_too_often():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 64)
    h[0] = 0
    plan = packing.solve_slots(h, 64)
    assert (plan["used"] <= h).all() and plan["used"].sum() > 0.5 * h.sum()
    x = packing.nnls_counts(packing.combinations(64), h.astype(float))
    assert (x >= 0).all()


def test_packing_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    p = packing.pack(spark, docs, byte_encoder()).toPandas().sort_values(["doc_id", "start"])
    e = packing.Encoder.of(*byte_encoder())
    for r in docs.collect():
        ids = np.array([*e.ids(r["text"]), 0], "<u4")
        own = p[p.doc_id == r["doc_id"]]
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32))
    sizes = p.groupby("sequence_id").length.sum()
    assert (sizes <= 1024).all() and ((sizes == 1024) | ((sizes & (sizes - 1)) == 0)).all()




@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30))
@settings(max_examples=150, deadline=None)
def test_bit_parallel_distance(item, window):
    rows = list(range(len(item) + 1))
    best = len(item)
    for ch in window:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(rows[j] + (x != ch), rows[j + 1] + 1, new[j] + 1))
        rows = new
        best = min(best, rows[-1])
    assert decontamination.nearest(window, len(item), decontamination.masks(item))[0] == best


def test_leaks_with_edits_are_found():
    item = "the quick brown fox jumps over the lazy dog while the band plays a slow old tune"
    m = decontamination.Matcher([(7, item)], 0.08)
    spoiled = item.replace("quick", "quack").replace("lazy", "hazy")
    assert m.matches("x y z " * 30 + spoiled.upper() + "!! more words") == [(0, 2, 6 * 30 + len(item))]
    assert not m.matches(item[: len(item) // 2])


def brute_repeats(rows, depth=50):
    seen, out = set(), {}
    for i, raw in sorted(rows):
        cover, new = bytearray(len(raw)), set()
        for p in range(len(raw) - depth + 1):
            g = raw[p : p + depth]
            if g in seen:
                cover[p : p + depth] = b"\1" * depth
            else:
                new.add(g)
        seen |= new
        kept = bytes(c for c, m in zip(raw, cover) if not m)
        out[i] = (len(raw), sum(cover), sum(1 for j in range(len(raw)) if cover[j] and not (j and cover[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rng = np.random.default_rng(1)
    base = [r["text"] for r in docs.select("text").limit(20).collect()]
    mixed = [(100_000 + i, base[i % 20][: int(rng.integers(30, 200))] * int(rng.integers(1, 3)) + base[(3 * i) % 20][-int(rng.integers(40, 120)) :]) for i in range(60)]
    every = docs.select("doc_id", "text").unionAll(spark.createDataFrame(mixed, "doc_id bigint, text string"))
    want = brute_repeats([(r["doc_id"], r["text"].encode()) for r in every.collect()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark, every).collect()}
    assert got == want


def test_rows_that_share_an_id_keep_their_own_bytes(spark):
    """Only X repeats document 1; Y, which has the same id as X, loses nothing, nor do they take from each other."""
    passage, other = "a passage that two documents hold and that is long enough to be found", "another text that no document with a smaller id than five holds at all"
    rows = [(1, passage), (5, passage + " X"), (5, other + " Y"), (5, other + " Y"), (5, other + " Z"), (9, other), (-3, "negative " + passage)]
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    size = len(passage)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == sorted(
        [(-3, size + 9, 0), (1, size, size), (5, size + 2, size), (5, len(other) + 2, 0), (5, len(other) + 2, 0), (5, len(other) + 2, 0), (9, len(other), len(other))]
    )


def test_hot_anchors_are_dealt_anew(spark, sf, monkeypatch):
    """With a bound of one context, every shared anchor goes by its neighbours; the result stays that of brute force."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    want = brute_repeats([(r["doc_id"], r["text"].encode()) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark, docs).collect()}
    assert got == want


@given(st.binary(min_size=1, max_size=80), st.integers(8, 24))
@settings(max_examples=100, deadline=None)
def test_refinement_groups_equal_prefixes(raw, depth):
    raw = bytes(b % 3 for b in raw)
    ids = suffix_dedup.refine(np.frombuffer(raw, "u1"), np.full(len(raw), len(raw)), depth)
    full = [p for p in range(len(raw)) if p + depth <= len(raw)]
    for p in full:
        for q in full:
            assert (ids[p] == ids[q]) == (raw[p : p + depth] == raw[q : q + depth])


@given(st.lists(st.sets(st.integers(0, 60), min_size=0, max_size=40), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_sketches_fill_and_agree(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sk = near_duplicates.sketches(arrays, 64)
    again = near_duplicates.sketches(arrays[::-1], 64)[::-1]
    assert (sk == again).all()
    assert all((sk[i] != near_duplicates._EMPTY).all() == bool(s) for i, s in enumerate(sets))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, sf, width):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    base = [r["text"].split() for r in docs.orderBy("doc_id").limit(6).collect()]
    rng, more = np.random.default_rng(2), []
    for i in range(80):
        w = list(base[i % 6])
        for k in rng.integers(0, len(w), max(1, len(w) // int(rng.integers(8, 60)))):
            w[k] = f"w{rng.integers(9)}"
        more.append((200_000 + i, " ".join(w)))
    every = docs.unionAll(spark.createDataFrame(more, "doc_id bigint, text string"))
    sets = {}
    for r in every.collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(spark, every, width).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}


def test_vectors_recall(spark, sf):
    v = table(spark, sf, "embeddings")
    x = v.toPandas()
    rng = np.random.default_rng(3)
    base = np.stack(x.embedding)[:40].astype("f8")
    near = base[rng.integers(0, 40, 200)] + rng.normal(size=(200, base.shape[1])) * 0.03
    every = np.vstack([np.stack(x.embedding), near])
    df = spark.createDataFrame([(i, [float(c) for c in e]) for i, e in enumerate(every)], "vec_id bigint, embedding array<double>")
    r = pivot_index.near_vectors(spark, df).toPandas().sort_values("vec_id")
    u = every / np.linalg.norm(every, axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    assert g.sum() > 400 and r.n_links.sum() >= 0.9 * g.sum() and (r.n_links.to_numpy() <= g.sum(axis=1)).all()


def test_language_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    r = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95


def test_code_switched_words_get_both_languages(spark, sf):
    docs = table(spark, sf, "documents")
    m = language_id.fit(language_id.training_words(docs))
    words = {x: language_id.words_of(docs.where(f"lang = '{x}'").orderBy("doc_id").first()["text"])[:30] for x in ("en", "de")}
    scores, mask = language_id.chains(m.scores(words["en"] + words["de"]), [len(words["en"]) + len(words["de"])])
    marginal, _ = language_id.forward_backward(scores, mask, m.transition)
    best = [m.labels[i] for i in marginal[mask].argmax(axis=1)]
    n = len(words["en"])
    assert collections.Counter(best[:n]).most_common(1)[0][0] == "en" and collections.Counter(best[n:]).most_common(1)[0][0] == "de"


def test_toxicity_held_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    r = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    clean = r[r.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.95


def test_main_text_on_built_pages():
    m = main_text.fit([main_text.featured(x) for x in main_text.built_pages(500)])
    held = main_text.built_pages(100, seed=99)
    right = [m.states(b) == y for b, y in held]
    assert np.mean(right) > 0.9
    page = '<html><head><title>t</title><body><div class="menu"><a href=x>Home</a></div><article><h1>Head</h1><p>One &lt;two&gt;<br>three.</p><aside>Also read</aside><p>Four</p></article><section class="comments"><p>Nice post, thank you all for it</p></section><footer>(c)</footer>'
    assert m.text(page) == "Head\n\nOne <two> three.\n\nFour"
