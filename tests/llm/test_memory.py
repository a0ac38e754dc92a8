"""What a task holds at once: it must not grow with the table, and little of it may be there twice."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from codewarden.llm import collocations, ngram_join

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_sorted_hashes_are_sent_without_copies_of_all():
    h = np.arange(500_000, dtype=np.uint64) << np.uint64(28)
    a = np.ones(len(h), np.int64)
    collocations.runs(h[:9], a[:9], 3)
    tracemalloc.start()
    try:
        collocations.runs(h, a, 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * len(h)


def test_tallied_hashes_are_those_of_a_loop():
    rng = np.random.default_rng(3)
    for h in (np.zeros(0, np.uint64), rng.integers(0, 50, 2000, np.uint64), np.full(600, (1 << 48) - 1, np.uint64)):
        want = Counter(h.tolist())
        got, n = collocations.tallied(h.copy())
        assert list(zip(got.tolist(), n.tolist())) == sorted(want.items())
        sent = collocations.runs(got, n, 1)
        if len(h):
            back, sums = collocations.read_runs(pa.Table.from_batches([sent]))
            assert dict(zip(back.tolist(), sums.tolist())) == want


def test_classes_are_the_same_however_many_hashes_a_task_holds(spark, monkeypatch):
    texts = [f"one two three four five six w{i % 7} x{i % 3} y{i}" for i in range(1200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    found = []
    for held in (100, 1_000_000):
        monkeypatch.setattr(ngram_join, "HELD", held)
        found.append(ngram_join.class_filters(docs, 5))
    assert all(x[0] == y[0] and (x[1] == y[1]).all() for x, y in zip(*found))


def test_each_stage_gets_texts_in_portions(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    before = spark.conf.get(ROWS)
    try:
        for given, most in ((10_000, corpus_pipeline.PORTION), (0, corpus_pipeline.PORTION), (7, 7)):
            spark.conf.set(ROWS, given)
            stage = corpus_pipeline.in_portions(lambda spark, docs, sf_dir: docs.mapInArrow(size, "n long"))
            sizes = [r["n"] for r in stage(spark, spark.range(2500).coalesce(1), "").collect()]
            assert max(sizes) == most and sum(sizes) == 2500
    finally:
        spark.conf.set(ROWS, before)
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
