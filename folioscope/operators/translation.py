"""Counts over nested pipeline documents and captured translation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import HAN, strip

#: Schema of a pipeline document.
LINE = "array<struct<text:string,translated_text:string>>"
DOCUMENT = f"errors array<string>, pages array<struct<input_kind:string,blocks:array<struct<text_lines:{LINE},image_overlay_text:{LINE},table:struct<rows:int,cols:int,cells:array<struct<row:int,col:int,rowspan:int,colspan:int,text:string,translated_text:string,raw:struct<translated_text:string>>>>>>>>"
LANGUAGES = ("en", "zh")


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + f(x))


def text_line_count(pages: Column) -> Column:
    """Lines of all blocks, without overlays and copies in cells; null where pages, blocks, lines or a line's text are missing."""
    blocks = F.flatten(F.transform(pages, lambda p: p["blocks"]))
    lines = F.flatten(F.transform(blocks, lambda b: b["text_lines"]))
    return F.when(F.forall(lines, lambda x: x["text"].isNotNull()), F.size(lines))


def evidence_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, translated, current): every text-bearing entry of documents (doc_id, pages). A cell has two
    translations, its own and its raw one, and one current text."""
    blocks = docs.select("doc_id", F.explode_outer("pages").alias("p")).select("doc_id", F.explode_outer("p.blocks").alias("b"))
    none = F.lit(None).cast("string")
    lines = [blocks.select("doc_id", F.lit(c).alias("kind"), F.explode(f"b.{c}").alias("x")).select("doc_id", "kind", F.col("x.translated_text").alias("translated"), none.alias("current")) for c in ("text_lines", "image_overlay_text")]
    cells = blocks.select("doc_id", F.explode("b.table.cells").alias("c"))
    own = cells.select("doc_id", F.lit("cell").alias("kind"), F.col("c.translated_text").alias("translated"), F.col("c.text").alias("current"))
    raw = cells.select("doc_id", F.lit("cell").alias("kind"), F.col("c.raw.translated_text").alias("translated"), none.alias("current"))
    return lines[0].unionByName(lines[1]).unionByName(own).unionByName(raw)


def translation_coverage(docs: DataFrame, script: str = HAN) -> DataFrame:
    """(doc_id, page_count, nonempty_translated_entries, translated_entries_with_script, current_cells_with_script)."""
    filled = F.coalesce(strip("translated") != "", F.lit(False))
    counts = evidence_lines(docs).groupBy("doc_id").agg(F.count_if(filled).alias("nonempty_translated_entries"), F.count_if(filled & F.col("translated").rlike(script)).alias("translated_entries_with_script"), F.count_if(F.col("current").rlike(script)).alias("current_cells_with_script"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts.columns[1:]]
    return docs.select("doc_id", F.size("pages").cast("long").alias("page_count")).join(counts, "doc_id", "left").select("doc_id", "page_count", *zero)


def one_or_many(v: Column) -> Column:
    """A variant string or array of strings as an array; null for anything else, and for an array with anything else in it."""
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    strings = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(kind.startswith("ARRAY"), F.when(F.forall(strings, lambda s: s.isNotNull()), strings))


def response_counts(logs: DataFrame, script: str = HAN, languages: tuple[str, str] = LANGUAGES) -> DataFrame:
    """(log_id, request_count, response_entries, response_entries_with_script, error) of requests (log_id, source, target, q, translated), q and
    translated variants. An error says which rule the log breaks; its counts stand all the same."""
    q, t = one_or_many(F.col("q")), one_or_many(F.col("translated"))
    full = lambda a: F.forall(a, lambda s: strip(s) != "")
    matched = F.coalesce((F.size(q) > 0) & (F.size(q) == F.size(t)) & full(q) & full(t), F.lit(False))
    turned = F.coalesce((F.col("source") == languages[0]) & (F.col("target") == languages[1]), F.lit(False))
    rows = logs.select("log_id", turned.alias("turned"), matched.alias("matched"), F.size(t).alias("n"), F.size(F.filter(t, lambda s: s.rlike(script))).alias("k"))
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("matched"), F.col(c))), F.lit(0)).cast("long")
    out = rows.groupBy("log_id").agg(F.count(F.lit(1)).alias("request_count"), kept("n").alias("response_entries"), kept("k").alias("response_entries_with_script"), F.bool_and("turned").alias("turned"), F.bool_and("matched").alias("matched"))
    error = F.when(~F.col("turned"), "wrong direction").when(~F.col("matched"), "one nonempty string per input is required").when(F.col("response_entries_with_script") == 0, "no translation in the target script")
    return out.select("log_id", "request_count", "response_entries", "response_entries_with_script", error.alias("error"))


def semantic_coverage(regions: DataFrame, *keys: str) -> DataFrame:
    """(required, preserved) regions per key (documented roll-up)."""
    return regions.groupBy(*keys).agg(F.count_if("required").alias("required"), F.count_if(F.col("required") & F.col("preserved")).alias("preserved"))


def training_ready(reviews: DataFrame, held_families: DataFrame, least: int = 2) -> DataFrame:
    """Regions with so many agreeing reviewers whose family is in no held split (documented gate). reviews: region_id, family, reviewer, text."""
    agreed = reviews.groupBy("region_id", "family", "text").agg(F.count_distinct("reviewer").alias("reviewers")).filter(F.col("reviewers") >= least)
    alone = agreed.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("region_id")
    return agreed.join(alone, "region_id", "left_semi").join(held_families.select("family"), "family", "left_anti")
