"""Snapshots of a stream, each against the one before; repeats and restarts."""

from spandrel.streaming.snapshots import _kept, snapshot_differ


def test_batches_compare_with_the_one_before(spark, tmp_path):
    seen = []
    path = f"file://{tmp_path}/snapshots"
    frame = lambda *rows: spark.createDataFrame(rows, "id bigint, v string")
    start = lambda: snapshot_differ(["id"], lambda n, d: seen.append((n, d.summary()["rows_added"], d.summary()["cells_changed"])), path)
    run = start()
    run(frame((1, "a")), 0)
    assert seen == []
    run(frame((1, "b"), (2, "c")), 1)
    run(frame((1, "b"), (2, "c")), 1)  # the batch runs again
    assert seen == [(1, 1, 1)] * 2
    start()(frame((1, "b"), (2, "d"), (3, "e")), 2)  # another process goes on
    assert seen[2:] == [(2, 1, 1)] and _kept(spark, path) == [1, 2]


def test_a_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    for i in range(3):
        spark.createDataFrame([(k, f"{k * i}") for k in range(4 + i)], "id bigint, v string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("id bigint, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
    differ = snapshot_differ(["id"], lambda n, d: seen.append(n), f"file://{tmp_path}/snapshots")
    query = stream.writeStream.foreachBatch(differ).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and seen == [1, 2]
