from pyspark.sql import functions as F

from lectern.plans import catalogue
from lectern.streaming import events

DATA = "/root/testdata/sf0.001"


def test_streams_end_like_their_batches(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    late = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    late.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all windows
    for make, name in ((events.tumbling, "events_tumbling"), (events.sessions, "events_sessions")):
        stream = make(events.read_events(spark, str(tmp_path / "in"), rows.schema), late="20 days")
        events.run_available(stream, str(tmp_path / f"check-{name}"), events.append_once(str(tmp_path / name)))
        got = spark.read.parquet(str(tmp_path / name))
        want = catalogue.QUERIES[name](spark, DATA)
        keys = [c for c in want.columns if c != "total"]
        assert sorted(map(tuple, got.where("begins is not null").select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))


def test_repeats_are_dropped_once(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    rows.limit(50).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.once(events.read_events(spark, str(tmp_path / "in"), rows.schema), late="3650 days")
    events.run_available(stream, str(tmp_path / "check"), events.append_once(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()
