"""Which way a document goes, and how much recognition work it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import ink_length, strip

# Thresholds and aliases of the routing policy.
MIN_CHARS, MIN_RATIO = 40, 0.6
WARN_PAGES, LONG_PAGES, SYNC_PAGES = 6, 20, 5
ALIASES = {"": "auto", "native": "direct", "text": "direct", "pdf": "direct", "pdf_to_word": "direct", "pdf-to-word": "direct", "ocr_word": "ocr", "ocr-word": "ocr"}
MODES = ("auto", "direct", "ocr")


def conversion_mode(value: Column) -> Column:
    mode = F.lower(strip(F.coalesce(value, F.lit(""))))
    mode = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[mode], mode)
    return F.when(mode.isin(*MODES), mode).otherwise("auto")


def setting(value: Column | None, default: int) -> Column:
    """A whole number, or the default where it is absent, zero or no number."""
    if value is None:
        return F.lit(default)
    return F.coalesce(F.nullif(F.try_to_number(value.cast("string"), F.lit("S999999999")).cast("int"), F.lit(0)), F.lit(default))


def page_metrics(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_count, text_pages, total_text_chars) from one row a page."""
    ink = ink_length(F.col(text))
    return pages.select(key, ink.alias("ink")).groupBy(key).agg(F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("ink") >= MIN_CHARS).alias("text_pages"), F.sum("ink").cast("long").alias("total_text_chars"))


def decide(path: Column, requested: Column, output_format: Column) -> Column:
    """struct(mode, reason, page_count, text_pages, total_text_chars) over columns page_count, text_pages, total_text_chars; null counts mean a failed look."""
    pages, texts, chars = (F.col(c).cast("long") for c in ("page_count", "text_pages", "total_text_chars"))
    mode = conversion_mode(requested)
    base = F.element_at(F.split(path, "/"), -1)
    failed = pages.isNull()
    dense = (texts / F.greatest(pages, F.lit(1)) >= MIN_RATIO) & (chars / F.greatest(pages, F.lit(1)) >= MIN_CHARS)
    reason = (
        F.when(~base.rlike(r"(?i)[^.].*\.pdf\z|^\..+\.pdf\z"), "not_pdf")
        .when(F.lower(strip(F.coalesce(output_format, F.lit("")))) != "docx", "not_docx")
        .when(mode == "direct", "forced_direct")
        .when(mode == "ocr", "forced_ocr")
        .when(failed, "preflight_failed")
        .when(pages <= 0, "empty_pdf")
        .when(dense, "text_pdf")
        .otherwise("low_text_density")
    )
    counted = reason.isin("not_docx", "text_pdf", "low_text_density") & ~failed
    shown = lambda c: F.when(counted, c).otherwise(F.lit(0)).cast("long")
    return F.struct(F.when(reason.isin("forced_direct", "text_pdf"), "direct").otherwise("ocr").alias("mode"), reason.alias("reason"), shown(pages).alias("page_count"), shown(texts).alias("text_pages"), shown(chars).alias("total_text_chars"))


def scan_risk(decision: Column, warn: Column | None = None, long_task: Column | None = None, sync: Column | None = None) -> Column:
    """struct of the work that recognition means: pages, level, whether to wait for it, and warnings in order."""
    warn, long_task, sync = setting(warn, WARN_PAGES), setting(long_task, LONG_PAGES), setting(sync, SYNC_PAGES)
    reads = (decision["mode"] == "ocr") & (decision["reason"] != "not_pdf")
    todo = F.when(reads, F.greatest(decision["page_count"] - decision["text_pages"], F.lit(0))).otherwise(F.lit(0)).cast("long")
    scanned = todo > 0
    level = F.when(~scanned, "none").when(todo >= long_task, "very_long").when(todo >= warn, "long").otherwise("normal")
    waits = ~scanned | (todo <= sync)
    warnings = F.array_compact(F.array(F.when(scanned & (todo >= warn), "scan_pdf_long_task"), F.when(scanned & (todo >= long_task), "scan_pdf_very_long_task"), F.when(scanned & ~waits, "sync_not_recommended")))
    return F.struct(
        todo.alias("estimated_ocr_pages"), scanned.alias("is_scanned_pdf"), level.alias("estimated_time_level"), waits.alias("sync_recommended"),
        sync.cast("long").alias("max_sync_pages"), warn.cast("long").alias("warn_pages"), long_task.cast("long").alias("long_task_pages"), warnings.alias("warnings"),
    )


def route(docs: DataFrame, path: Column, requested: Column, output_format: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    decided = docs.select(*keep, decide(path, requested, output_format).alias("decision"))
    return decided.select(*keep, "decision.*", scan_risk(F.col("decision")).alias("risk")).select(*keep, "mode", "reason", "page_count", "text_pages", "total_text_chars", "risk.*")
