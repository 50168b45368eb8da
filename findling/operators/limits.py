"""Rate limits over a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MICROS = 1_000_000


def rate_limit(ev: DataFrame, limit: int, seconds: int, slot_windows: int = 2) -> DataFrame:
    """Attempts of the user in the trailing ``(t - w, t]`` and whether they exceed ``limit``.

    All attempts count, and equal timestamps see each other. A user's events are
    cut into time slots so that a busy user fills many tasks; each slot also
    holds the last ``w`` of the slot before, which is all its first events need.
    """
    width = seconds * MICROS
    slot = width * slot_windows
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = F.expr(f"(micros - pmod(micros, {slot}L)) div {slot}L")
    lends = F.pmod(F.col("micros"), F.lit(slot)) >= slot - width
    slots = F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))
    trailing = W.partitionBy("user_id", "slot").orderBy("micros").rangeBetween(-(width - 1), 0)
    return (
        ev.withColumn("micros", micros)
        .withColumn("own", own)
        .withColumn("slot", F.explode(slots))
        .withColumn("attempts", F.count(F.lit(1)).over(trailing))
        .filter(F.col("slot") == F.col("own"))
        .withColumn("throttled", F.col("attempts") > limit)
        .drop("micros", "own", "slot")
    )


def fixed_counters(ev: DataFrame, size: str = "1 hour") -> DataFrame:
    """One counter per user and tumbling window."""
    return (
        ev.groupBy(F.window(F.col("ts"), size).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w")["start"].alias("window_start"), "n")
    )
