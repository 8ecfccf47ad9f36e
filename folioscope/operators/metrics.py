"""Roll-ups of region scores, timings and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def region_metrics() -> list[Column]:
    """Ten aggregates over region scores. Ratios are null without a denominator; review is no credit for recognition."""
    n, chars, critical = F.count(F.lit(1)), F.sum("reference_characters"), F.sum("critical_characters")
    pending = F.col("needs_review")
    lost = F.sum(F.when(pending, F.greatest("critical_errors", "critical_characters")).otherwise(F.col("critical_errors")))
    kept = lambda x: F.greatest(F.lit(0.0), 1 - _share(x, critical))
    some = lambda x: F.when(critical > 0, x)
    return [
        n.alias("regions"),
        _share(F.sum("edits"), chars).alias("cer"),
        _share(F.count_if(F.col("exact") & ~pending), n).alias("annotation_accuracy"),
        some(kept(lost)).alias("critical_character_accuracy"),
        _share(F.count_if("exact"), n).alias("raw_annotation_accuracy"),
        some(kept(F.sum("critical_errors"))).alias("raw_critical_character_accuracy"),
        _share(F.count_if(~F.col("found")), n).alias("miss_rate"),
        _share(F.count_if(pending), n).alias("review_rate"),
        chars.cast("long").alias("reference_characters"),
        critical.cast("long").alias("critical_characters"),
    ]


def aggregate_regions(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*region_metrics())


def rollup_regions(rows: DataFrame, *keys: str) -> DataFrame:
    """The same at every level from all keys to none; level: how many keys are summed over."""
    names = [F.col(k) for k in keys]
    return rows.rollup(*names).agg(*region_metrics(), F.grouping_id().alias("level"))


def micro_error_rate() -> list[Column]:
    """Counts, and an error rate that is zero (not null) without reference characters."""
    return [F.count_if("exact").alias("exact"), F.count(F.lit(1)).alias("n"), (F.sum("edits") / F.greatest(F.lit(1), F.sum("reference_characters"))).cast("double").alias("cer")]


def timing(value: str) -> list[Column]:
    """Median of the middle two, and the nearest rank at 95 %."""
    v = F.col(value)
    return [F.median(v).alias("p50_seconds"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95_seconds"), F.max(v).alias("max_seconds"), F.sum(v).alias("total_seconds"), F.count(v).alias("runs")]


def request_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Linear percentiles of requests that succeeded, apart from warm-ups; null if none did."""
    rows = rows.filter(~F.col("warmup"))
    good = F.when(F.col("success"), F.col("seconds"))
    p = F.percentile(good, F.array(F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy(*keys).agg(p.alias("p"), F.max(good).alias("max_seconds"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
    return out.select(*keys, F.get("p", F.lit(0)).alias("p50_seconds"), F.get("p", F.lit(1)).alias("p95_seconds"), "max_seconds", "succeeded", "failed")


def check_rollup(checks: DataFrame, *keys: str) -> DataFrame:
    """ok, and how many checks passed and failed; no checks at all are ok."""
    aggs = [F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"), F.count_if("passed").alias("checks_passed"), F.count_if(~F.col("passed")).alias("checks_failed")]
    return checks.groupBy(*keys).agg(*aggs) if keys else checks.agg(*aggs)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def against_baseline(measured: DataFrame, expected: DataFrame, keys: list[str], fields: list[str], tolerance: float | None = None) -> DataFrame:
    """One row a key and field: measured and expected value, and whether they agree (nulls agree with nulls)."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{f}', cast({f} as double)" for f in fields)
        return df.select(*keys, F.expr(f"stack({len(fields)}, {pairs}) as (field, {name})"))

    both = tall(measured, "measured").join(tall(expected, "expected"), [*keys, "field"], "full_outer")
    same = F.col("measured").eqNullSafe(F.col("expected"))
    if tolerance is not None:
        same = same | F.coalesce(F.abs(F.col("measured") - F.col("expected")) < tolerance, F.lit(False))
    return both.withColumn("passed", same)
