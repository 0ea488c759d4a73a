"""The active-model state: one row, read with defaults for whatever is missing, and its transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "version int, active_collection string, active_model string, ab struct<enabled boolean, candidate_collection string, candidate_model string, "
    "traffic_ratio double, started_at string, baseline_metrics struct<hit1 double, hit5 double, mrr double, n long>>, updated_at string"
)
DEFAULTS = {"version": 1, "active_collection": "notes", "active_model": "lexical"}
RATIO = 0.2


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row: the first stored state, or the defaults where it or a field of it is missing."""
    stored = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path).limit(1)
    row = spark.range(1).select(F.lit(1).alias("_one")).join(stored.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    filled = {k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()}
    ab = F.struct(F.coalesce("ab.enabled", F.lit(False)).alias("enabled"), F.col("ab.candidate_collection").alias("candidate_collection"), F.col("ab.candidate_model").alias("candidate_model"), F.coalesce("ab.traffic_ratio", F.lit(RATIO)).alias("traffic_ratio"), F.col("ab.started_at").alias("started_at"), F.col("ab.baseline_metrics").alias("baseline_metrics"))
    return row.withColumns({**filled, "ab": ab})


def transition(state: DataFrame, action: str, now: str) -> DataFrame:
    """`promote` makes the candidate active under the next version; `rollback` forgets it; else nothing changes."""
    if action == "promote":
        state = state.withColumns({"active_collection": F.coalesce("ab.candidate_collection", "active_collection"), "active_model": F.coalesce("ab.candidate_model", "active_model"), "version": F.col("version") + 1})
    if action in ("promote", "rollback"):
        cleared = F.col("ab").withField("enabled", F.lit(False)).withField("candidate_collection", F.lit(None).cast("string")).withField("candidate_model", F.lit(None).cast("string")).withField("started_at", F.lit(None).cast("string"))
        state = state.withColumns({"ab": cleared, "updated_at": F.lit(now)})
    return state


def save(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").json(path)


def candidate_name(version: int) -> str:
    return f"candidate_v{version + 1}"
