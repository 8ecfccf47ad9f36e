"""When a region is read again, whether what comes back is usable, and whether it changes anything critical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import SPACE, critical_reading, strip

# The risks of each priority, finish reasons of cut output, and openings that are talk and no transcript.
HIGH_RISKS = (
    "unexplained_neighbor_ink", "leading_glyph_requires_verification", "positioned_candidate_conflict", "stacked_tolerance_fragment", "diameter_glyph_ambiguous",
    "tolerance_sign_ambiguous", "letter_digit_confusable", "multiplication_glyph_ambiguous", "critical_candidate_conflict",
)
MIDDLE_RISKS = ("detected_empty_region", "direction_recognition_failed", "formula_unverified")
JOINT_RISKS = ("low_confidence", "critical_engineering_annotation")
LOW_RISK = "dimension_symbol_completeness_unverified"
CUT = ("length", "max_tokens")
TALK = rf"(?i)^{SPACE}*(?:the (?:image|text|formula)|here (?:is|are)|识别结果[：:]|转写结果[：:])"


def risk_priority(risks: Column) -> Column:
    """0 to 2, or null where nothing calls for another reading."""
    any_of = lambda names: F.arrays_overlap(risks, F.array(*map(F.lit, names)))
    both = F.size(F.array_intersect(risks, F.array(*map(F.lit, JOINT_RISKS)))) == 2
    return F.when(any_of(HIGH_RISKS), 0).when(any_of(MIDDLE_RISKS) | both, 1).when(F.array_contains(risks, LOW_RISK), 2)


def braces_balance(text: Column) -> Column:
    """Unescaped braces never close before they open, and all close."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\[{}]", ""), r"[^{}]", "")
    signs = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.when(c == "{", 1).otherwise(-1))
    end = F.aggregate(signs, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), lambda s, x: F.struct((s["depth"] + x).alias("depth"), (s["ok"] & (s["depth"] + x >= 0)).alias("ok")))
    return end["ok"] & (end["depth"] == 0)


def output_status(status: Column, text: Column, truncated: Column, finish: Column, task: Column) -> Column:
    """ok, or the first reason why an output is not: its own status comes first."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(~status.eqNullSafe(F.lit("ok")), F.coalesce(F.nullif(status, F.lit("")), F.lit("invalid_response")))
        .when(F.coalesce(truncated, F.lit(False)) | F.coalesce(finish.isin(*CUT), F.lit(False)), "truncated")
        .when(trimmed == "", "empty_output")
        .when(F.contains(text, F.lit("```")) | F.contains(text, F.lit("\x00")) | text.rlike(TALK), "nonliteral_output")
        .when((task == "text") & trimmed.rlike(r"[\n\r]"), "multiple_annotation_output")
        .when((task == "formula") & ~braces_balance(text), "invalid_formula_structure")
        .otherwise("ok")
    )


def weight_identity(model: Column) -> Column:
    """What proves which weights ran: a digest, or an id with its revision; a label alone proves nothing."""
    said = lambda *names: F.coalesce(*[F.nullif(model[n], F.lit("")) for n in names])
    name, revision = said("id", "model_id"), said("revision", "commit_hash")
    return F.coalesce(said("weight_identity", "weights_sha256", "weight_sha256"), F.concat(name, F.lit("@"), revision))


def critical_change(old: Column, new: Column, task: Column) -> Column:
    return (task == "formula") | (critical_reading(old) != critical_reading(new))


def schedule(regions: DataFrame, group: str, priority: str, position: str, most: int = 16) -> DataFrame:
    """The first regions of each page by priority, then position (documented scheduling; unranked regions are not read)."""
    line = Window.partitionBy(group).orderBy(priority, position)
    return regions.filter(F.col(priority).isNotNull()).withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= most)
