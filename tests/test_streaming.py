"""Streaming decisions equal the batch fold, whatever the micro-batches."""

import time

from pyspark.sql import functions as F

from wayfold.plans import decide as D
from wayfold.plans import scenario
from wayfold.streaming import decisions as S

SF = "/root/testdata/sf0.001"


def stream_rows(spark):
    fix = scenario.relation(spark, SF, "fix").select("session_id", "line_no", F.lit("fix").alias("kind"), "raw_id", "provider", "has_t", "t", "recv", "start_t", "lat", "lng", "acc", "speed", "mock", F.lit(False).alias("forced"))
    motion = scenario.relation(spark, SF, "motion").select("session_id", "line_no", F.lit("motion").alias("kind"), "t0", "t1", "samples", "rms", "score", "still")
    fix = fix.join(scenario.relation(spark, SF, "fix").select("session_id", "line_no", F.coalesce("snap_id", F.lit(-1)).alias("snap_id")), ["session_id", "line_no"])
    snap = scenario.relation(spark, SF, "snap").select("session_id", "line_no", F.lit("snap").alias("kind"), "snap_id", "t", "used", "used_cn0", "top4_cn0")
    rows = fix.unionByName(motion, allowMissingColumns=True).unionByName(snap, allowMissingColumns=True)
    return rows.select(*[c.split()[0] for c in S.INPUT.split(", ")])


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    rows = stream_rows(spark)
    cut = 120

    def run():
        source = spark.readStream.schema(S.INPUT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = S.decide_stream(source, silence=None).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()

    # The second run goes on from the first one's checkpoint, with its states and snapshots.
    rows.where(F.col("line_no") < cut).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    run()
    rows.where(F.col("line_no") >= cut).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    run()
    got = sorted((r.session_id, r.decision_id, r.result, r.reason, r.point_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = D.decide(*[scenario.relation(spark, SF, n) for n in ("fix", "motion", "snap")])
    want = sorted((r.session_id, r.decision_id, r.result, r.reason, r.point_id) for r in batch.collect())
    assert got == want


def test_silence_gives_one_timeout(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    stream_rows(spark).where("session_id = 1").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(S.INPUT).parquet(f"{tmp_path}/in")
    q = S.decide_stream(source, silence=500).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    for _ in range(60):
        time.sleep(0.5)
        if spark.table("quiet").where("reason = 'no_location_timeout'").count():
            break
    time.sleep(1.5)
    q.stop()
    assert spark.table("quiet").where("reason = 'no_location_timeout'").count() == 1


def test_broken_rule_equals_the_column_form(spark):
    fix = scenario.relation(spark, SF, "fix")
    for r in D.validated(fix).collect():
        assert S.broken_rule(r, r.now) == r.invalid


def test_snapshot_buffer_finds_and_forgets():
    b, second = S.Snapshots(), 1_000_000_000
    for k in range(400):
        b.add(k, k * second // 2, k, float(k))
    assert len(b.rows) == 300 and b.find(99, 0) is None and b.find(100, 0)[0] == 100
    assert b.find(None, 150 * second)[0] == 300 and b.find(None, 150 * second + 200)[0] == 300
    assert b.find(None, 49 * second)[0] == 100 and b.find(None, 300 * second) is None
    b.add(400, 1000 * second, 1, None)
    assert [r[0] for r in b.rows] == [400]
