import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.llm import common, exact_dedup, ngram_join

from .helpers import ODD, documents
from .test_operators import prose


def test_stages_follow_one_another(spark, tmp_path):
    rng = random.Random(1)
    a, bench = prose(rng, 90), prose(rng, 20)
    rows = [(i, prose(rng, 60), "en", rng.choice(["a", "b", None])) for i in range(80)]
    rows += [(100, a), (101, a), (102, a + " and more"), (103, prose(rng, 30) + " " + bench), (104, None), (105, "123 456"), *[(200 + (i or 0), t) for i, t in ODD]]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = [r["doc_id"] for r in docs.collect()]
    assert 104 not in ids["language ID"] and 105 not in ids["language ID"] and 100 in ids["language ID"]
    assert 101 not in ids["exact dedup"] and 102 in ids["exact dedup"]
    assert 102 not in ids["n-gram Jaccard join"] and 100 in ids["n-gram Jaccard join"]
    assert 103 not in ids["benchmark decontamination"] and {*range(80)} <= {*ids["benchmark decontamination"]}
    assert len(ids["mixing sources"]) == len(ids["benchmark decontamination"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in whole) == sorted(ids["mixing sources"])
    assert sorted(map(tuple, whole)) == sorted(map(tuple, docs.collect()))


def test_live_results_outlast_further_runs(spark, tmp_path):
    rng = random.Random(2)
    text = prose(rng, 40)
    rows = [(i, text if i % 3 == 0 else prose(rng, 40), "en", "a") for i in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    exact, near = exact_dedup.exact_dedup(docs), ngram_join.classes(docs)
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    counts = [x.count() for x in (exact, near, first, second)]
    assert counts[:2] == [40, 40] and counts[2] == counts[3] > 0
    assert not common._blocks


def test_tables_of_a_block_are_deleted_and_no_others(spark):
    outer = common.materialise(spark.range(3), "outer")
    with common.temporary(spark) as kept:
        inner = common.materialise(spark.range(4), "inner")
        path, = common._blocks[-1]
        out, own = kept(inner.union(outer), "kept")
    assert outer.count() == 3 and out.count() == 7 and own in common._left and path not in common._left
    jvm = spark.sparkContext._jvm
    there = lambda x: jvm.org.apache.hadoop.fs.Path(x).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(x))
    assert there(own) and not there(path)
    common.discard(spark, own)
    assert not there(own) and own not in common._left


def test_empty_tables_and_clashing_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    names = ["_p", "_p_", "_gone_id", "_gone_sha", "_id", "_sha", "_row", "_again", "sig", "key"]
    rows = [(i, "same words as all the others here" if i < 9 else f"other text {i} " * 9) for i in range(30)] + [(3, "same words as all the others here"), (None, "x y")]
    docs = documents(spark, rows).withColumns({c: F.lit(c) for c in names})
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in names), name


def test_stages_bound_what_a_worker_gets_at_once(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(i, f"some words of text {i}") for i in range(20)])
    texts = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("word "), 1_000).alias("t"))  # 15 MB in one partition

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    before = spark.conf.get(key)
    try:
        for name, f in corpus_pipeline.STAGES:
            spark.conf.set(key, "64m")
            f(spark, docs, str(tmp_path))
            got = texts.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r["n"] for r in got) == 3_000 and max(r["bytes"] for r in got) < 5 << 20, name
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_sets_are_made_in_bounded_memory():
    rng = random.Random(3)
    texts = [prose(rng, 400) for _ in range(2_000)] + ["", "one", "x " * 400_000]
    alone = [ngram_join.document_sets(pa.array([t], pa.large_string()), 5)[0] for t in texts]
    whole = pa.array(["left out", *texts], pa.large_string()).slice(1)
    tracemalloc.start()
    try:
        sets = ngram_join.document_sets(whole, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone, strict=True))
    assert peak < 60 << 20  # hashed in one go they took 158 MB
