"""Sources: strict JSON, positional bundles, nested maps, raw files, Word containers."""

from __future__ import annotations

import io
import sys
import zipfile

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import HAN
from folioscope.operators.integrity import in_ignored_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# Signatures of file kinds, and the name space of Word's elements.
SIGNATURES = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "zip": b"PK"}
#: Field order of score bundles that name no fields of their own.
REGION_FIELDS = ("id", "exact", "found", "edits", "reference_characters", "critical_errors", "critical_characters", "needs_review")
REGION_TYPES = {"id": "string", "exact": "boolean", "found": "boolean", "needs_review": "boolean"}
#: A table drawn once as a fixture: row, col, rowspan, colspan, text come from such relations.
CELL_DDL = "row int, col int, rowspan int, colspan int, text string"


def read_json(spark: SparkSession, path, schema: str, lines: bool = False) -> DataFrame:
    """Whole-file JSON (or JSON lines) of a fixed schema; malformed input fails."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def decode_bundles(bundles: DataFrame, fields: Column | None = None) -> DataFrame:
    """One row for each of a bundle's rows: the bundle's own columns, and the row's values by field name, cast.

    bundles has rows array<array<string>> and, unless given, fields array<string>.
    """
    names = fields if fields is not None else F.col("fields")
    keep = [c for c in bundles.columns if c not in ("rows", "fields")]
    each = bundles.select(*keep, names.alias("__names"), F.posexplode("rows").alias("row_pos", "__row"))
    each = each.withColumn("__map", F.map_from_arrays(F.col("__names"), F.slice("__row", F.lit(1), F.size("__names"))))
    return each.select(*keep, "row_pos", *[F.try_element_at("__map", F.lit(f)).cast(REGION_TYPES.get(f, "int")).alias(f) for f in REGION_FIELDS])


def route_bundles(rows: DataFrame) -> DataFrame:
    """rows with group: by suite; a diagnostics row belongs to a group for each of its categories."""
    whole = F.col("stage").isin("paddle", "qwen")
    group = (
        F.when(F.col("suite") == "diagnostics", F.transform("categories", lambda c: F.concat(F.lit("diagnostics/"), c, F.lit("/"), F.col("view"))))
        .when(F.col("suite") == "controls", F.array(F.lit("controls/synthetic")))
        .when(F.col("suite") == "regions", F.array(F.concat(F.lit("regions/"), "kind")))
        .when(F.col("suite") == "pages", F.array(F.concat(F.lit("pages/"), F.when(whole, F.col("kind")).otherwise(F.concat_ws("/", "scene", "kind")))))
    )
    return rows.withColumn("group", F.explode(group))


def flatten_map(df: DataFrame, column: str, *names: str) -> DataFrame:
    """Nested maps to rows: a key column for each level, and the columns of the last struct."""
    keep = [c for c in df.columns if c != column]
    out = df.withColumnRenamed(column, "__m")
    for n in names:
        out = out.select(*keep, F.explode("__m").alias(n, "__m"))
        keep.append(n)
    return out.select(*keep, "__m.*")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, content) of all files but those of ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    full = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.when(full.startswith(F.concat(base, F.lit("/"))), F.substring(full, F.length(base) + 2, F.length(full))).otherwise(full)
    rows = files.select(F.try_url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), "content")
    return rows.filter(~in_ignored_folder(F.col("path")))


def has_signature(content: Column, kind: str) -> Column:
    magic = SIGNATURES[kind]
    return F.coalesce(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit(False))


WORD_PARTS = T.StructType([T.StructField("document", T.StringType()), T.StructField("fonts", T.IntegerType()), T.StructField("error", T.StringType())])


@F.pandas_udf(WORD_PARTS)
def word_parts(content: pd.Series) -> pd.DataFrame:
    """The main part of a Word container and its number of embedded fonts; error for what is no sound container."""
    rows = []
    for raw in content:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                bad = z.testzip()
                if bad is not None:
                    rows.append((None, 0, f"damaged member {bad}"))
                    continue
                names = z.namelist()
                fonts = sum(n.startswith("word/fonts/") and n.endswith(".odttf") for n in names)
                rows.append((z.read("word/document.xml").decode("utf-8"), fonts, None))
        except Exception as e:  # any unreadable container is a failed row, not a failed job
            rows.append((None, 0, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["document", "fonts", "error"])


def _count(xml: Column, name: str) -> Column:
    return F.xpath_int(xml, F.lit(f"count(//*[local-name()='{name}'])"))


def _texts(xml: Column, path: str) -> Column:
    return F.array_join(F.xpath(xml, F.lit(f"{path}//*[local-name()='t']/text()")), "")


def inspect_word(files: DataFrame) -> DataFrame:
    """(path, error, tables, grid_spans, vertical_merges, frames, fonts, han, table_han) of Word files (path, content).

    The container is opened in Python; all that is counted is counted by XPath over its main part.
    """
    parts = files.select("path", word_parts("content").alias("p")).select("path", "p.*")
    xml = F.col("document")
    body = F.when(F.col("error").isNull() & ~F.coalesce(xml.rlike(r"<(\w+:)?document[\s>]") & xml.rlike(r"<(\w+:)?body[\s/>]"), F.lit(False)), "no document body")
    parts = parts.withColumn("error", F.coalesce("error", body))
    safe = F.when(F.col("error").isNull(), xml)
    han = lambda c: F.regexp_count(c, F.lit(HAN)).cast("long")
    return parts.select(
        "path", "error", _count(safe, "tbl").alias("tables"), _count(safe, "gridSpan").alias("grid_spans"), _count(safe, "vMerge").alias("vertical_merges"),
        _count(safe, "framePr").alias("frames"), "fonts", han(_texts(safe, "")).alias("han"), han(_texts(safe, "//*[local-name()='tbl']")).alias("table_han"),
    )


def word_boxes(words: DataFrame, sx: Column | float, sy: Column | float) -> DataFrame:
    """words (…, x1, y1, x2, y2 in points) with pixel boxes, halves rounded to even."""
    px = lambda c, s: F.bround(F.col(c) * s).cast("int")
    return words.withColumn("bbox_pixels", F.array(px("x1", sx), px("y1", sy), px("x2", sx), px("y2", sy)))
