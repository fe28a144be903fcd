"""What the operators share: keys, filters, repeated rows, labels, batches."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sumi.llm import base

from .conftest import make


def test_key_filter_never_misses(spark):
    frame = make(spark, [(k, f"t{k}", "a") for k in range(3000)])
    keyed = frame.withColumn("row_key", base.row_key(frame))
    some = keyed.where("doc_id % 10 = 0").select("row_key")
    for bits, most in ((27, 0), (14, 400)):
        passed = [r.doc_id for r in keyed.where(base.key_filter(some, bits)(F.col("row_key"))).collect()]
        assert set(range(0, 3000, 10)) <= set(passed)
        assert len(passed) - 300 <= most


@pytest.mark.parametrize("bits", [27, 6])
def test_times(spark, monkeypatch, bits):
    """Planned keys, repeated rows, and rows that the filter lets through without a plan."""
    monkeypatch.setattr(base, "FILTER_BITS", bits)
    rows = [(k, f"t{k}", "a") for k in range(40)] + [(3, "t3", "a")] * 5 + [(None, None, None)] * 4 + [(50, "t50", "b")] * 3
    frame = make(spark, rows)
    keyed = frame.withColumn("row_key", base.row_key(frame))
    copies = F.when(F.col("doc_id").isNull(), 0).when(F.col("doc_id") == 3, 2).when(F.col("doc_id") < 9, 0)
    plan = keyed.withColumn("copies", copies).where("copies is not null").select("row_key", "copies")
    got = Counter(r.doc_id for r in base.times(frame, plan).collect())
    assert got == Counter({k: 1 for k in range(9, 40)} | {3: 12, 50: 3})
    doubled = Counter(r.doc_id for r in base.times(frame, plan, F.lit(2)).collect())
    assert doubled == Counter({k: 2 for k in range(9, 40)} | {3: 12, 50: 6})


def test_text_does_not_meet_the_plan_but_behind_the_filter(spark):
    frame = make(spark, [(k, f"t{k}", "a") for k in range(40)])
    plan = frame.where("doc_id < 3").select(base.row_key(frame).alias("row_key"), F.lit(0).alias("copies"))
    explained = base.times(frame, plan)._jdf.queryExecution().executedPlan().toString()
    straight, met = explained.split("Union", 1)[1].split("maybe", 1)[0], explained
    assert "Exchange" not in straight and "Exchange" in met


def test_training_labels_are_bounded(spark):
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    every = base.training_labels(labels, "toxic", 10**6)
    assert 3800 < every.count() < 4200
    assert 800 < base.training_labels(labels, "toxic", 1000).count() <= 1000
    assert every.join(labels, "doc_id").where("__y <> toxic").count() == 0


def test_batches_leave_the_session_alone(spark):
    before = {k: spark.conf.get(k) for k in base.TEXT_BATCH}
    with base.text_batches(spark):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert before == {k: spark.conf.get(k) for k in base.TEXT_BATCH}


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "local-cluster[3,2,3000]"

    with pytest.raises(ValueError):
        base.scratch(Session)


def test_row_keys(spark):
    frame = spark.createDataFrame([(1, "a", "k"), (1, "a", "k"), (1, "a", "l"), (None, None, None)], "doc_id long, text string, row_key string")
    keys = [r[0] for r in frame.select(base.row_key(frame)).collect()]
    assert keys[0] == keys[1] and len({tuple(k) for k in keys}) == 3


def test_text_batches_are_small(spark):
    """A batch of whole texts stays near a megabyte, a longer text is a batch of its own."""
    texts = [(k, "w" * 40_000, "a") for k in range(300)] + [(400, "w" * 3_000_000, "a")]
    frame = make(spark, texts).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([sum(map(len, batch.column(0).to_pylist()))])], names=["n", "size"])

    with base.text_batches(spark):
        found = frame.select("text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 301 and sum(r["size"] for r in found) == 300 * 40_000 + 3_000_000
    assert max(r["size"] for r in found if r["size"] < 3_000_000) < 1_200_000


def test_workers_drop_what_other_operators_keep(spark):
    """The tokenizer and its caches stay for the tasks of packing, and go when a task of another operator begins."""
    import public_tokenizers

    from sumi.llm import minhash, packing, toxicity

    file = public_tokenizers.path("word_bpe_49k.json")
    frame = make(spark, [(k, f"some words of text {k}", "a") for k in range(20)]).coalesce(1)
    marked = frame.withColumn("__y", F.lit(0))
    base.drop_kept()
    ids = packing.word_ids(file)
    assert packing.word_ids(file) is ids
    base.drop_kept(file)
    assert packing.word_ids(file) is ids

    def of_workers():
        return {r.pid: r.n for r in frame.select("doc_id").mapInArrow(kept_in_worker, "pid long, n long").collect()}

    def kept_in_worker(batches):
        import os

        from sumi.llm import base as here

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(here._kept)])], names=["pid", "n"])

    for other in (lambda: toxicity.count_cells(marked, "__y"), lambda: minhash.word_idf(frame)):
        packing.pieces(frame, file).collect()
        before = of_workers()
        other()
        after = of_workers()
        assert all(after[p] == 0 for p in before.keys() & after.keys())
    base.drop_kept()
