"""Year files arriving one by one score like the batch run."""

from pyspark.sql import functions as F

from cohortscope.session import staging_root
from cohortscope.streaming.scoring import score_arrivals


def test_arrivals_equal_batch(spark, ws):
    base = f"{staging_root(spark)}/arrivals"
    for y in (2024, 2025):
        ws.panel.filter(F.col("tax_year") == y).write.mode("append").parquet(base)
    stream = spark.readStream.schema(ws.panel.schema).option("maxFilesPerTrigger", 2).parquet(base)
    q = (score_arrivals(stream, ws.medians, ws.statistics)
         .select("person_id", "tax_year", "z_irs_risk_score", "total_flag_count",
                 "network_risk_score")
         .writeStream.format("memory").queryName("arrivals").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("arrivals")
    want = ws.scored.filter("tax_year >= 2024").select(
        "person_id", "tax_year", F.col("z_irs_risk_score").alias("z"),
        F.col("total_flag_count").alias("n"), F.col("network_risk_score").alias("r"))
    both = got.join(want, ["person_id", "tax_year"])
    assert both.count() == want.count() == got.count()
    assert both.filter("abs(z_irs_risk_score - z) > 1e-9 or total_flag_count <> n "
                       "or abs(network_risk_score - r) > 1e-9").isEmpty()
