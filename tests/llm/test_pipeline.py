"""The pipeline's stages, each against what it must keep."""

import corpus_pipeline
from codesieve.llm import bpe, decontamination, near_dup, queries, secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secret_scan", "bpe"]
    weights = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in toxicity.score(docs, weights).where("predicted = 0").collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert ids(clean) == keep and clean.columns == docs.columns
    single = stages["near_dedup"](spark, clean, SF).cache()
    classes = {r.doc_id: r.class_id for r in near_dup.duplicate_classes(clean).collect()}
    assert ids(single) == set(classes.values()) and single.columns == docs.columns
    free = stages["decontamination"](spark, single, SF).cache()
    assert ids(single) - ids(free) == ids(decontamination.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")))
    masked = stages["secret_scan"](spark, free, SF).cache()
    assert ids(masked) == ids(free) and masked.columns == docs.columns
    assert not secret_scan.scan_secrets(masked).where("n_assign + n_access + n_hex > 0").count()
    encoded = stages["bpe"](spark, masked, SF)
    assert ids(encoded) == ids(masked)
    assert ids(corpus_pipeline.run(spark, SF)) == ids(masked)


def test_queries_are_registered():
    assert [int(q.split("_")[0][2:]) for q in queries.QUERIES] == list(range(1, 14))


def test_the_driver_makes_the_word_table_without_a_tokenizer(spark):
    from pathlib import Path

    definition = Path(queries.tokenizer_path()).read_text(encoding="utf-8")
    texts = spark.createDataFrame([("the cat the cat the cat sat sat sat",)], "text string")
    bpe.load_tokenizer.cache_clear()
    bpe._named.cache_clear()
    table, size = bpe.word_table(texts, definition)
    assert bpe.load_tokenizer.cache_info().currsize == bpe._named.cache_info().currsize == 0  # neither is held beside the driver's heap
    ids = [" ".join(map(str, x)) for x in bpe.encode_words(definition, table.words.split())]
    assert table.words == "cat sat the" and table.ids.split("\n") == ids and table.texts.split("\n") == bpe.pieces_of(definition, ids) and size >= 33
