"""Nulls, empty tables, very long texts, ties, repeated rows and clashing columns."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import bpe, common, decontamination, near_dup, queries, substring_dedup, toxicity, url_filter
from codesieve.sources.corpus import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{table}.parquet").where("false").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert not queries.QUERIES[name](spark, str(tmp_path)).collect()


def test_urls_and_their_shapes(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert not url_filter.judge_urls(empty, queries.URL_RULES).collect()
    rules = spark.createDataFrame([("b.c", "", "block"), ("b.c", "", "allow"), ("a.b.c", "/x", "allow"), ("c", "/xyz", "block")], "host string, prefix string, verdict string")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(["s://a.b.c/xy", "s://b.c/q", "s://c/xyzz", "s://c/x", "s://q.a.b.c", None, "s://b.c/q"])], "page_id long, url string")
    shipped = {r.page_id: tuple(r) for r in url_filter.judge_urls(pages, [tuple(r) for r in rules.collect()]).collect()}
    assert {r.page_id: tuple(r) for r in url_filter.judge_by_join(pages, rules).collect()} == shipped
    assert [shipped[k][3] for k in range(7)] == ["a.b.c/x", "b.c", "c/xyz", None, "b.c", None, "b.c"]
    assert [shipped[k][4] for k in range(7)] == ["allow", "block", "block", "allow", "block", "allow", "block"]
    many = spark.range(url_filter.MAX_SHAPES + 1).select(F.lit("c").alias("host"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("prefix"), F.lit("block").alias("verdict"))
    with pytest.raises(ValueError):
        url_filter.judge_by_join(pages, many)


def test_leaks_in_long_repeated_and_tied_texts(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    item = rng.choices(words, k=30)
    long = [*rng.choices(words, k=100_000), *item, *rng.choices(words, k=100_000)]
    texts = [(1, " ".join(long)), (2, " ".join(item + item)), (2, " ".join(item + item)), (None, " ".join(item)), (4, "")]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, None), (None, "w1 w2 w3")], "item_id long, text string")
    rows = [r for r in decontamination.find_leaks(docs_of(spark, texts), benchmark).collect() if r.item_id in (7, 8)]
    count = lambda i, item: sum(r.doc_id == i and r.item_id == item for r in rows)
    assert [count(i, k) for i in (1, 2, None, 4) for k in (7, 8)] == [1, 1, 4, 4, 1, 1, 0, 0]
    assert {(r.first_word, r.last_word) for r in rows if r.doc_id == 1} == {(100_000, 100_029)} and {r.score for r in rows} == {1.0}


def noisy_or(weights, text):
    """A document's score as one minus the chance that no sentence offends, counted anew."""
    raw = text.encode()
    bags = toxicity.Bags(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    evidence = np.zeros(len(bags.first))
    for at, feature in bags.features:
        np.add.at(evidence, bags.sentence[at], weights[feature])
    chances = [1 / (1 + np.exp(-(weights[-1] + e))) for e in evidence if e > 0]
    return 1 - np.prod([1 - p for p in chances])


def test_toxicity_on_driver_labels_and_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weights = toxicity.train(docs, labels)
    scored = toxicity.score(docs, weights).join(labels, "doc_id").where(toxicity.held_out("doc_id") & F.col("toxic").isNotNull()).select("predicted", "toxic").collect()
    assert len(scored) > 50 and np.mean([r.predicted == r.toxic for r in scored]) > 0.95
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 40 = 0 AND text IS NOT NULL").collect()}
    single = weights.astype(np.float32).astype(float)
    single[-1] = weights[-1]
    for r in toxicity.score(docs.where(F.col("doc_id").isin(list(texts))), weights).collect():
        assert r.score == pytest.approx(noisy_or(single, texts[r.doc_id]), abs=1e-5)
    odd = docs_of(spark, [(1, "word " * 300_000), (2, None), (2, None), (3, "..."), (None, "a")])
    assert len(toxicity.score(odd, weights).collect()) == 5 and toxicity.drop_toxic(odd, weights).columns == odd.columns
    assert not toxicity.score(odd.where("false"), weights).collect() and not toxicity.drop_toxic(odd.where("false"), weights).collect()


def test_packed_numbers():
    rng = random.Random(3)
    rows = [[rng.randrange(1 << rng.randint(0, 28)) for _ in range(rng.randint(0, 9))] for _ in range(50)]
    packed = bpe.packed(np.array([x for row in rows for x in row]), np.array(list(map(len, rows)))).to_pylist()
    values, bounds = bpe.unpacked(packed)
    assert [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == rows


def test_pipeline_on_odd_tables(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(80))
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(1, text), (2, text), (2, text), (3, text + " end"), (4, None), (5, ""), (6, item), (None, "lonely words here"), (7, "token = Zx9Qw3Er7Ty1Ui5Op2As8Df4 tail"), (8, "long " * 100_000)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4, 7, 8, None} and got[4].n_tokens == 0 and "zx9" not in got[7].decoded and got[8].n_tokens == 100_000
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, whole.where("false"), str(tmp_path)).collect(), name


def test_long_blocks_and_released_memory():
    import pyarrow as pa

    assert [hi - lo for lo, hi, _, _ in common.blocks(pa.array(["x" * 10, "y", "z" * 30, None]), 11)] == [2, 1, 1]
    assert list(common.released(lambda batches: iter(batches))([1, 2])) == [1, 2]


def test_planted_copies_are_found(spark):
    """Recall against all pairs on the given documents, near copies included."""
    from test_operators import jaccard_classes

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.class_id for r in near_dup.duplicate_classes(docs).collect()}
    assert rows == jaccard_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_substrings_without_ids(spark):
    rows = substring_dedup.dedup_windows(docs_of(spark, [(None, "a " * 30), (None, "a " * 30)])).collect()
    assert [r.n_removed for r in rows] == [0, 0] and stored(docs_of(spark, [])).count() == 0
