"""The stream carries a key's state over batches and over a restart."""

from pyspark.sql import functions as F

from riskgrid.operators import replan
from riskgrid.operators.shared import folder
from riskgrid.plans import windows
from riskgrid.streaming.triggers import decisions, stream_triggers


def few(spark, sf_dir):
    rows = windows.observations(spark, sf_dir).withColumn("key", F.col("seq") % 3).where("seq < 240")
    return spark.createDataFrame(rows.collect(), rows.schema)


def test_several_batches_decide_as_one_fold(spark, sf_dir):
    o = few(spark, sf_dir)
    whole = sorted(map(tuple, replan.triggers(o).collect()), key=str)
    assert {r[2] for r in whole} >= {"fire", "wait"}
    assert sorted(map(tuple, stream_triggers(o, files=4).collect()), key=str) == whole


def test_a_restarted_stream_goes_on(spark, sf_dir):
    o = few(spark, sf_dir)
    base = folder(spark, "test-restart")
    cut = o.approxQuantile("at_us", [0.5], 0.0)[0]

    def run():
        source = spark.readStream.schema(o.select(*replan.OBSERVATION).schema).parquet(f"{base}/in")
        sink = decisions(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        sink.awaitTermination()

    o.where(F.col("at_us") <= cut).select(*replan.OBSERVATION).coalesce(1).write.parquet(f"{base}/in")
    run()
    o.where(F.col("at_us") > cut).select(*replan.OBSERVATION).coalesce(1).write.mode("append").parquet(f"{base}/in")
    run()
    got = spark.read.schema(replan.DECISIONS).parquet(f"{base}/out")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, replan.triggers(o).collect()), key=str)
