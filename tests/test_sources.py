"""The page source and the append-only log."""

import json

import pytest

from plumbline.sources import pages


@pytest.fixture
def folder(tmp_path):
    for f, n in (("a.jsonl", 5), ("b.jsonl", 40)):
        (tmp_path / f).write_text("\n".join(json.dumps([["word", 1.0 * p, 2.0, 3.0, 4.0, f"{f} {p} {k}"] for k in range(p % 3)]) for p in range(1, n + 1)) + "\n")
    (tmp_path / "_hidden").write_text("not json")
    return tmp_path


def test_pages_are_read_by_runs_and_filters_reach_the_reader(spark, folder):
    pages.register(spark)
    df = spark.read.format("page_primitives").option("path", str(folder)).option("pages", "16").load()
    want = sorted((str(folder / f), p, k, f"{f} {p} {k}") for f, n in (("a.jsonl", 5), ("b.jsonl", 40)) for p in range(1, n + 1) for k in range(p % 3))
    got = lambda d: sorted((r["path"], r["page"], r["seq"], r["text"]) for r in d.collect())
    assert got(df) == want and df.rdd.getNumPartitions() == 4
    assert got(df.filter("page between 4 and 17 and seq = 0")) == [w for w in want if 4 <= w[1] <= 17 and w[2] == 0]
    assert got(df.filter(f"page in (2, 35) and path = '{folder / 'b.jsonl'}'")) == [w for w in want if w[1] in (2, 35) and w[0].endswith("b.jsonl")]
    assert got(df.filter("page > 100")) == []
    assert [r["x0"] for r in df.filter("page = 7").collect()] == [7.0]


def test_reader_plans_only_what_filters_leave(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    reader = pages.PageReader({"path": str(folder), "pages": "16"})
    rest = list(reader.pushFilters([IsNotNull(("page",)), GreaterThan(("page",), 16), LessThanOrEqual(("page",), 20), EqualTo(("kind",), "word")]))
    assert rest == [IsNotNull(("page",)), EqualTo(("kind",), "word")]
    assert [(p.path.rsplit("/", 1)[1], p.first, p.last) for p in reader.partitions()] == [("b.jsonl", 17, 32)]
    none = pages.PageReader({"path": str(folder)})
    assert not list(none.pushFilters([In(("path",), ("elsewhere",))])) and [list(none.read(p)) for p in none.partitions()] == [[]]
    with pytest.raises(FileNotFoundError):
        pages.PageReader({"path": str(folder / "missing")}).partitions()


def test_log_streams_what_was_appended(spark, tmp_path):
    """Each run takes whole lines from where the last one stopped; a line that is still being written waits."""
    pages.register(spark)
    log, out, mark = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "mark")
    log.mkdir()

    def drained():
        spark.readStream.format("append_log").option("path", str(log)).load().writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination(60)
        return sorted((r["file"].rsplit("/", 1)[1], r["at"], r["line"]) for r in spark.read.schema(pages.LOG).parquet(out).collect())

    (log / "one").write_text("first\nsecond\npart")
    assert drained() == [("one", 0, "first"), ("one", 6, "second")]
    with (log / "one").open("a") as f:
        f.write("ly\n")
    (log / "two").write_text("é\n")
    assert drained() == [("one", 0, "first"), ("one", 6, "second"), ("one", 13, "partly"), ("two", 0, "é")]
    batch = spark.read.format("append_log").option("path", str(log)).load()
    assert sorted(r["line"] for r in batch.collect()) == ["first", "partly", "second", "é"]


def test_orphaned_jobs_become_errors_when_time_passes(spark, tmp_path):
    """Two batches: in the first, jobs run; in the second a later event moves the watermark past the patience of a silent one."""
    pytest.importorskip("google.protobuf")
    from plumbline.streaming import jobs

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
        schema = "job string, state string, ts timestamp"

        def feed(rows):
            spark.createDataFrame(rows, "job string, state string, ts string").selectExpr("job", "state", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(src)

        def run():
            found = jobs.job_states(spark.readStream.schema(schema).parquet(src))
            q = found.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start()
            assert q.awaitTermination(150)
            return sorted((r["job"], r["state"], str(r["ts"]), r["orphan"]) for r in spark.read.parquet(out).collect())

        feed([("a", "queued", "2026-01-01 10:00:00"), ("a", "running", "2026-01-01 10:01:00"), ("b", "running", "2026-01-01 10:02:00"), ("c", "done", "2026-01-01 10:03:00")])
        first = run()
        assert first == [("a", "running", "2026-01-01 10:01:00", False), ("b", "running", "2026-01-01 10:02:00", False), ("c", "done", "2026-01-01 10:03:00", False)]
        feed([("b", "done", "2026-01-01 10:20:00"), ("c", "running", "2026-01-01 10:21:00"), ("d", "queued", "2026-01-01 12:00:00")])
        assert sorted(set(run()) - set(first)) == [("a", "error", "2026-01-01 10:31:00", True), ("b", "done", "2026-01-01 10:20:00", False), ("d", "queued", "2026-01-01 12:00:00", False)]
    finally:
        spark.conf.set(store, before)
