"""Sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.integrity import file_checks, identities

#: Top folders of frozen evidence; inside a package new output goes below this one only.
FROZEN, GENERATED = ("artifacts", "samples", "assets"), "generated"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _below(path: str, root: str) -> list[str] | None:
    a, b = ([x for x in p.removeprefix("file:").split("/") if x not in ("", ".")] for p in (path, root))
    return a[len(b) :] if a[: len(b)] == b else None


def guard_target(spark: SparkSession, path: str, roots: tuple[str, ...] = ()) -> None:
    """Refuse a target that is there, leaves its folder by "..", or lies in a package anywhere but below generated/."""
    if ".." in path.split("/"):
        raise ValueError("an output path must not contain ..")
    for root in roots:
        inside = _below(path, root)
        if inside is not None and (len(inside) < 2 or inside[0] != GENERATED):
            raise ValueError("inside the package, output must use generated/<new-name>")
    if exists(spark, path):
        raise ValueError("the output is there already; choose a new one")


def write_report(report: DataFrame, path: str, root: str | None = None) -> None:
    """One JSON line a row, at a new path outside the folders of frozen evidence."""
    inside = _below(path, root) if root else None
    if inside and inside[0] in FROZEN:
        raise ValueError("reports must not be written into frozen evidence")
    guard_target(report.sparkSession, path)
    report.coalesce(1).write.mode("errorifexists").json(path)


def pretty(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def export(files: DataFrame, manifest: DataFrame, path: str, roots: tuple[str, ...] = ()) -> DataFrame:
    """Write the listed files (path, content) as a new table if all of them match the manifest, read it back and check it again.

    Returns the checks of what was written; raises if anything differs before or after.
    """
    spark = files.sparkSession
    guard_target(spark, path, roots)
    if file_checks(manifest, identities(files)).filter("not passed").limit(1).count():
        raise ValueError("checks failed; nothing exported")
    files.join(manifest.select("path"), "path", "left_semi").write.mode("errorifexists").parquet(path)
    checks = file_checks(manifest, identities(spark.read.parquet(path)))
    if checks.filter("not passed").limit(1).count():
        raise ValueError("the exported package failed its check")
    return checks
