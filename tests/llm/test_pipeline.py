"""The corpus pipeline, stage by stage, against plain versions on a small corpus with every odd row."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_brute import least_distance
from tests.llm.test_exact import brute_repeats
from vegaflow.llm import decontamination, toxicity
from vegaflow.llm.common import table
from vegaflow.llm.packing import Encoder
from vegaflow.llm.queries import byte_encoder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, sf, tmp_path_factory):
    """A folder with documents (nulls, empties, repeats, a planted leak), labels and benchmark."""
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(90).collect()]
    item = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    odd = [(9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, " \n ", "en", "x", 3), (9004, rows[0][1], "en", "x", 1), (9005, f"before {item} after", "en", "x", 1), (9006, "quick brown fox", "en", "x", 1), (9007, "ünï 日本 " * 30, "ja", None, 1), rows[1]]
    spark.createDataFrame(rows + odd, SCHEMA).write.parquet(f"{root}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{root}/{name}.parquet")
    return root


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_against_plain_versions(spark, corpus):
    docs = table(spark, corpus, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]

    model = toxicity.fit(*toxicity.training_words(docs, table(spark, corpus, "labels")))
    kept = stages["toxicity"](spark, docs, corpus)
    assert rows_of(kept) == sorted((tuple(r) for r in docs.collect() if model.score(r["text"]) < 0.7), key=str)

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    single = stages["near_duplicates"](spark, kept, corpus)
    assert rows_of(single) == sorted((tuple(r) for r in kept.collect() if find(r["doc_id"]) == r["doc_id"]), key=str)

    cut = stages["suffix_dedup"](spark, single, corpus)
    removed = {i: n for i, (_, n, *_) in brute_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in single.select("doc_id", "text").distinct().collect()]).items()}
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in cut.collect():
        text = before[r["doc_id"]]
        if not removed[r["doc_id"]]:
            assert r["text"] == text
        else:
            gone = len(text.encode()) - len(r["text"].encode())
            assert removed[r["doc_id"]] <= gone <= removed[r["doc_id"]] + 6 and r["n_chars"] == len(r["text"])
    assert cut.schema == docs.schema and sum(removed.values()) > 0

    clean = stages["decontamination"](spark, cut, corpus)
    items = [decontamination.normalise(r["text"]) for r in table(spark, corpus, "benchmark").collect()]
    leaks = {r["doc_id"] for r in cut.collect() if any(least_distance(x, decontamination.normalise(r["text"])) <= decontamination.budget(x, 0.08) for x in items)}
    assert rows_of(clean) == sorted((tuple(r) for r in cut.collect() if r["doc_id"] not in leaks), key=str)
    assert 9005 in leaks or 9005 not in before

    pieces = stages["packing"](spark, clean, corpus).toPandas()
    encoder = Encoder.of(*byte_encoder())
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    copies = {r["doc_id"]: r["count"] for r in clean.groupBy("doc_id").count().collect()}
    assert set(pieces.doc_id) == set(texts)
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array([*encoder.ids(texts[i] or ""), 0], "<u4")
        assert own.doc_tokens.iloc[0] == len(ids)
        assert own.length.sum() == copies[i] * len(ids)  # a repeated row is packed as often as it is there
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32))
    filled = pieces.groupby("sequence_id").length.sum()
    assert (filled <= 1024).all()


def test_an_empty_corpus_gives_no_rows(spark, corpus, tmp_path):
    table(spark, corpus, "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, corpus, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_its_stages(spark, corpus):
    docs = table(spark, corpus, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == table(spark, corpus, "documents").columns, name
    got = corpus_pipeline.run(spark, corpus).select("doc_id", "start", "length", "ids_crc32")
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}
