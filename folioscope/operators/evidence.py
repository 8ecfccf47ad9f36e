"""Added evidence: candidates are appended, sources never change, and review is only ever asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import is_number, strip

RESOLUTION = "vlm_candidate_requires_review"
LIMIT = 8


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")


def attach(regions: DataFrame, candidates: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, candidates and rejected evidence after observations are merged.

    regions: report_id, region_id, needs_review, resolution. candidates: report_id, region_id, pos, text, status, reason,
    source, confidence. observations: report_id, pos, region_id, text, status, reason. An observation of an unknown region is
    rejected; others become candidates of source "vlm" without confidence unless an equal one is there, after those there.
    """
    key = ["report_id", "region_id"]
    known = regions.select(*key).distinct()
    rejected = observations.join(known, key, "left_anti").select("report_id", "pos", "region_id", F.lit("unknown_region").alias("reason"))
    met = observations.join(known, key)
    body = ["text", "status", "reason", "source", "confidence"]
    new = met.select(*key, F.lit(1).alias("late"), "pos", "text", "status", "reason", F.lit("vlm").alias("source"), F.lit(None).cast("double").alias("confidence"))
    old = candidates.select(*key, F.lit(0).alias("late"), "pos", *body)
    every = old.unionByName(new)
    # what was there stays, copies included; of new ones only the first unlike all others
    nth = F.row_number().over(Window.partitionBy(*key, *body).orderBy("late", "pos"))
    every = every.withColumn("nth", nth).filter("late = 0 or nth = 1").drop("nth")
    order = Window.partitionBy(*key).orderBy("late", "pos")
    every = every.withColumn("pos", F.row_number().over(order) - 1).drop("late")
    touched = met.select(*key).distinct().withColumn("touched", F.lit(True))
    after = regions.join(touched, key, "left")
    hit = F.col("touched").isNotNull()
    after = after.withColumn("needs_review", F.col("needs_review") | hit).withColumn("resolution", F.when(hit, RESOLUTION).otherwise(F.col("resolution"))).drop("touched")
    return after, every, rejected


def propagate(owners: DataFrame, regions: DataFrame) -> DataFrame:
    """Owners take review state and resolution of their unique region where it is known."""
    state = regions.select("report_id", "region_id", F.col("needs_review").alias("r_review"), F.col("resolution").alias("r_resolution"), F.lit(True).alias("matched"))
    both = owners.join(state, ["report_id", "region_id"], "left")
    take = lambda new, own: F.when(F.col("matched"), F.col(new)).otherwise(F.col(own)).alias(own)
    rest = [c for c in owners.columns if c not in ("needs_review", "resolution")]
    return both.select(*rest, take("r_review", "needs_review"), take("r_resolution", "resolution"))


def admissible(text: Column, status: Column, reason: Column) -> Column:
    """A candidate that may stand in a dimension: read well, without a reason against it, one number without inner gaps."""
    return (text != "") & (F.coalesce(status, F.lit("ok")) == "ok") & (F.coalesce(reason, F.lit("")) == "") & ~text.rlike(r"(?U)\d\s+\d") & is_number(text)


def part_options(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(group_id, part, role, region_id, option, text, source, candidate_index): admitted candidates first, then what was
    observed in place, each text once. parts: group_id, part, role, region_id, observed array<string>."""
    text = strip(F.coalesce("text", F.lit("")))
    read = candidates.select("region_id", F.col("pos").alias("candidate_index"), text.alias("text"), "status", "reason").filter(admissible(F.col("text"), F.col("status"), F.col("reason")))
    seen = parts.select("group_id", "part", "role", "region_id", F.posexplode("observed").alias("at", "text")).select("group_id", "part", "role", "region_id", F.lit(1).alias("late"), "at", "text", F.lit("positioned_observation").alias("source"), F.lit(None).cast("int").alias("candidate_index"))
    found = parts.select("group_id", "part", "role", "region_id").join(read, "region_id").select("group_id", "part", "role", "region_id", F.lit(0).alias("late"), F.col("candidate_index").alias("at"), "text", F.lit("recognition").alias("source"), F.col("candidate_index").cast("int"))
    once = first_of(found.unionByName(seen), ["group_id", "part", "text"], ["late", "at"])
    order = Window.partitionBy("group_id", "part").orderBy("late", "at")
    return once.withColumn("option", (F.row_number().over(order) - 1).cast("int")).drop("late", "at")


def compose(parts: DataFrame, candidates: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(group_id, reviewed_candidates, unreviewed_part_ids, needs_review, review_status), one row a group.

    Combinations come in lexicographic order of options; as many options of a part as the limit are enough for the first
    ones, so no product is larger than the limit at any part.
    """
    limit = max(0, limit)
    options = part_options(parts, candidates)
    lists = options.filter(F.col("option") < limit).groupBy("group_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("option", "text"))), lambda x: x["text"]).alias("texts"))
    missing = parts.join(options.filter("source = 'recognition'").select("group_id", "part").distinct(), ["group_id", "part"], "left_anti")
    missing = missing.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "region_id"))), lambda x: x["region_id"]).alias("unreviewed_part_ids"))
    every = parts.select("group_id", "part").join(lists, ["group_id", "part"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    ordered = every.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "texts"))), lambda x: x["texts"]).alias("choices"))
    start = F.array(F.array().cast("array<string>"))
    grow = F.aggregate("choices", start, lambda done, texts: F.slice(F.flatten(F.transform(done, lambda d: F.transform(texts, lambda t: F.concat(d, F.array(t))))), 1, max(limit, 1)))
    out = ordered.join(missing, "group_id", "left").withColumn("unreviewed_part_ids", F.coalesce("unreviewed_part_ids", F.array().cast("array<string>")))
    combos = F.transform(grow, lambda c: F.array_join(c, " ")) if limit else F.array().cast("array<string>")
    status = F.when(F.size("unreviewed_part_ids") > 0, "partial").otherwise("candidates_available")
    return out.select("group_id", combos.alias("reviewed_candidates"), "unreviewed_part_ids", F.lit(True).alias("needs_review"), status.alias("review_status"))


def candidate_upper_bound(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(regions, reachable): how many regions have their true text among their candidates (documented upper bound)."""
    hit = candidates.join(truth, ["report_id", "region_id"]).filter(F.col("text") == F.col("reference")).select("report_id", "region_id").distinct().withColumn("hit", F.lit(True))
    return truth.join(hit, ["report_id", "region_id"], "left").agg(F.count(F.lit(1)).alias("regions"), F.count("hit").alias("reachable"))


def paired_changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Per key: regions that turned right, and that turned wrong (documented comparison)."""
    a = before.select("region_id", *keys, F.col("exact").alias("was"))
    both = a.join(after.select("region_id", F.col("exact").alias("now")), "region_id")
    return both.groupBy(*keys).agg(F.count_if(~F.col("was") & F.col("now")).alias("wrong_to_right"), F.count_if(F.col("was") & ~F.col("now")).alias("right_to_wrong"), F.count(F.lit(1)).alias("regions"))
