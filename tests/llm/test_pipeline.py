import hashlib
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import BITS, labelled, prose, table
from weftline.llm import simhash_dedup


#: Names that stages use inside.
CLASHING = "__fp __id __hash __random spans base_spans tokens base fp row words hashes h item start score toxic fold text_hash width n root best".split()


def test_stages_take_effect(spark, tmp_path):
    docs, labels = labelled(spark, lambda r: "zork" + r.choice(["el", "ina", "ot"]))
    item = " ".join(random.Random(1).choices("ash birch cedar elm fir oak pine yew".split(), k=40))
    long = prose(300, 999)
    more = [f"{prose(40, 5000)} {item} {prose(30, 5001)}", long, long, f"{prose(50, 5002)} token = abcdefghijklmnop1", None, None, ""]
    docs = docs.unionByName(table(spark, more, 1000)).withColumn("extra", docs.doc_id)
    docs = docs.withColumns({c: F.lit(c) for c in CLASHING})
    d = str(tmp_path / "sf")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    own = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, d)
        assert out.columns == own.columns
        out.write.parquet(f"{d}/{name}")
        own = spark.read.parquet(f"{d}/{name}")
        assert own.select(*CLASHING).distinct().collect() == [tuple(CLASHING)]
        ids[name] = {r.doc_id for r in own.collect()}
    toxic = {i for i in range(600) if i % 5 == 3}
    assert len(ids["toxicity"] & toxic) <= 5 and len(ids["toxicity"] - toxic) >= 480
    assert 1001 in ids["near_duplicates"] and not {1002, 1005, 1006} & ids["near_duplicates"] and 1004 in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {1000} and ids["secrets"] == ids["decontamination"]
    texts = {r.doc_id: r.text or "" for r in own.collect()}
    assert texts[1003].endswith("[SECRET]") and {r.doc_id: r.n_chars for r in own.collect()}[1003] == len(texts[1003])

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == ids["secrets"]
    for r in rows:
        want = [*lib.encode(texts[r.doc_id]), 2]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()


def test_null_ids(spark, tmp_path):
    docs, labels = labelled(spark, lambda r: "zork" + r.choice(["el", "ina", "ot"]))
    more = table(spark, [prose(60, 7001), prose(60, 7002), prose(60, 7002), None], 1000).withColumn("doc_id", F.lit(None).cast("long"))
    d = str(tmp_path / "sf")
    docs.unionByName(more).write.parquet(f"{d}/documents.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 1)], labels.schema)).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, "no such text"), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d).collect()
    assert sum(r.doc_id is None for r in rows) == 3 and len({r.decoded_sha256 for r in rows if r.doc_id is None}) == 3


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path / "sf")
    table(spark, [""]).limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    assert BITS and simhash_dedup.RADIUS == 3
