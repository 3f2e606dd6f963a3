"""The stages on small tables, each against a plain version of its decision."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from lumirel.llm import compression_classifier, exact_dedup, minhash, mixing


def test_stages_follow_each_other(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        outs[name] = (docs, out)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = out

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    before, out = outs["quality"]
    good = compression_classifier.quality_scores(before, labels).filter("predicted = 1")
    assert ids(out) == ids(good)
    clean = labels.filter("quality = 1").select("doc_id")
    assert before.join(clean, "doc_id").join(out.select("doc_id"), "doc_id", "left_anti").count() <= 0.02 * clean.count()
    before, out = outs["exact_dedup"]
    assert ids(out) == ids(exact_dedup.exact_dedup(before).filter("kept"))
    before, out = outs["near_dedup"]
    assert ids(out) == ids(minhash.near_dedup(before).filter("kept"))
    before, out = outs["mixing"]
    words = out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"))
    assert {r.doc_id: r.n for r in words.collect()} == {r.doc_id: r.taken for r in mixing.taken(before).collect() if r.taken}
    before, out = outs["tokens"]
    assert sorted((r.doc_id, r.decoded_sha256) for r in out.collect()) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_take_odd_rows_and_names(spark):
    sf_dir = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None), (900001, None), (900002, ""), (900003, " \n"), (900004, "word " * 40000), (900005, "same words in two rows"), (900005, "same words in two rows"), (None, "no id at all"), (900006, "no id at all")]
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], plain.schema)
    docs = plain.union(rows).withColumns({c: F.lit(7) for c in ("score", "predicted", "row", "routed", "kept", "key", "ids")})
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, sf_dir)
            if name == "tokens":
                assert out.count() == some.count()
            else:
                assert out.columns == docs.columns
                kept = out.collect()
                assert (some is docs) == bool(kept) and all(r.row == r.key == r.score == 7 for r in kept)
        if name == "exact_dedup":
            ids = [r.doc_id for r in stage(spark, docs, sf_dir).collect()]
            assert ids.count(900005) == 1 and ids.count(None) == 0
