import time

from oxbow import streaming as S
from oxbow.operators import ingest as I
from test_ingest import schedule

SCHEMA = "verse string, pos long, producer long, epoch int, sequence long, records long, digest string"


def drain(writer):
    q = writer.trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_admit_stream_equals_batch(spark, tmp_path):
    rows = schedule(9, 120)
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    drain(S.admit_stream(stream).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")))
    want = sorted(map(tuple, I.admit(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    got = sorted(map(tuple, spark.table("admitted").collect()), key=repr)
    assert sum(r[7] == "Accepted" for r in got) == sum(r[7] == "Accepted" for r in want)
    assert got == want


def test_seal_stream(spark, tmp_path):
    schema = "verse string, pos long, records long, bytes long"
    spark.createDataFrame([("v", i, 1, 10) for i in range(25)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    # With a processing-time timeout pending there is always another batch, so the query is stopped once it has told.
    q = S.seal_stream(stream, 10, 1000, 3_600_000).writeStream.format("memory").queryName("sealed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 45
        while spark.table("sealed").count() < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.batch, r.records, r.why) for r in spark.table("sealed").orderBy("batch").collect()] == [(0, 10, "records"), (1, 10, "records")]


def test_a_stream_without_pauses_is_sealed_by_age():
    held, told = (0, 0, 0, 0), []
    for now in range(0, 300, 30):
        held, out = S.seal(held, [(1, 1)], now, 100, 100, 100)
        told += [(now, *x) for x in out]
    assert told == [(120, 0, 4, 4, "age"), (240, 1, 4, 4, "age")]
    assert held == (2, 2, 2, 240)
    assert S.seal(held, [], 340, 100, 100, 100) == ((3, 0, 0, 240), [(2, 2, 2, "age")])
    assert S.seal((0, 0, 0, 0), [(3, 1), (1, 9)], 5, 3, 9, 100) == ((2, 0, 0, 5), [(0, 3, 1, "records"), (1, 1, 9, "bytes")])


def test_batches_left_alone_are_sealed_by_age(spark, tmp_path):
    schema = "verse string, pos long, records long, bytes long"
    spark.createDataFrame([("v", i, 1, 10) for i in range(3)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = S.seal_stream(stream, 10, 1000, 1_000).writeStream.format("memory").queryName("aged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 45
        while spark.table("aged").count() < 1 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r.batch, r.records, r.why) for r in spark.table("aged").collect()] == [(0, 3, "age")]


def test_batches_written_again_replace_themselves(spark, tmp_path):
    sink = S.parquet_batches(str(tmp_path / "out"))
    for _ in range(2):
        sink(spark.range(5).toDF("x"), 0)
    sink(spark.range(3).toDF("x"), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    seen = []
    S.append_once(lambda df, b: seen.append(b), lambda: 0)(None, 0)
    S.append_once(lambda df, b: seen.append(b), lambda: 0)(None, 1)
    assert seen == [1]
