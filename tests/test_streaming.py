from nestkit.functions import text as T
from nestkit.plans.unroll import unrolled
from nestkit.sources.tables import table
from nestkit.streaming.unroll import parquet_sink, unroll_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = table(spark, SF, "events").selectExpr("event_id", "props")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = unroll_stream(stream, "event_id", "props", 3, parquet_sink(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = unrolled(events, "event_id", "props", 3)
    got = spark.read.parquet(out).drop("batch").select(batch.columns)
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_text_functions_on_a_stream(spark, tmp_path):
    events = table(spark, SF, "events").select("event_id", "props")
    source = str(tmp_path / "in")
    events.write.parquet(source)
    fenced = spark.readStream.schema(events.schema).parquet(source).select("event_id", T.fence("props").alias("f"))
    query = fenced.writeStream.format("memory").queryName("fenced").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("fenced").exceptAll(events.select("event_id", T.fence("props").alias("f"))).count() == 0
