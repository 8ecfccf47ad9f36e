"""Whole verifications: each is a union of check rows (check_id, passed, error), never an exception.

A file table (path, content) is the package. JSON parts are parsed where they are needed; what cannot be read is a failed
check, and checks that depend on it are absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.integrity import file_checks, identities, link_errors, path_ok, provenance_mismatches, publication_errors, publication_report, suffix, unlisted
from folioscope.operators.metrics import aggregate_regions, against_baseline, check_rollup, micro_error_rate, timing
from folioscope.operators.tables import score_responses
from folioscope.operators.translation import DOCUMENT, response_counts, text_line_count, translation_coverage
from folioscope.sources.readers import has_signature, inspect_word, route_bundles

CHECK = ["check_id", "passed", "error"]
SCORES = ("cell_exact", "cell_total", "reference_characters", "character_edits", "cer", "matching_cell_spans", "predicted_cells", "true_positive", "false_positive", "false_negative")
PATHS_LOCAL = ("input", "json", "docx", "render_pdf")
PATHS_TRANSLATION = ("input", "source_json", "translated_json", "docx", "model_responses", "execution", "render_audit", "render_pdf")
CLEAN_REVIEW = ("overlap_seen", "clipping_seen", "page_overflow_seen", "source_text_ghosts_seen")


def check(df: DataFrame, check_id: Column, error: Column) -> DataFrame:
    return df.select(check_id.alias("check_id"), error.isNull().alias("passed"), error.alias("error"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def parsed(files: DataFrame) -> DataFrame:
    """(path, v): each file as a JSON variant, null if it is none."""
    text = F.col("content").cast("string")
    return files.select("path", F.try_parse_json(F.when(F.is_valid_utf8(text), text)).alias("v"))


def _str(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def _bool(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(v, f"$.{path}", "boolean"))


def _int(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(v, f"$.{path}", "long"))


def _filled(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    return F.coalesce(kind.isNotNull() & ~kind.isin("VOID", "OBJECT<>", "ARRAY<VOID>") & ~F.coalesce(_str(v, path) == "", F.lit(False)), F.lit(False))


def _strings(v: Column, path: str) -> Column:
    items = F.try_variant_get(v, f"$.{path}", "array<variant>")
    strings = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.when(F.forall(strings, lambda s: s.isNotNull()), strings)


class Record:
    """A run record: its manifest rows, its cases, and whether it can be read."""

    def __init__(self, files: DataFrame, record_path: str, schemas: tuple[str, ...], check_id: str, case_names: tuple[str, ...]):
        rec = files.filter(F.col("path") == record_path)
        one = files.sparkSession.range(1).select(F.lit(record_path).alias("path")).join(parsed(rec), "path", "left")
        v = F.col("v")
        listed = F.try_variant_get(v, "$.files", "map<string,variant>")
        cases = F.try_variant_get(v, "$.cases", "map<string,variant>")
        date = F.when(_str(v, "run_date").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(_str(v, "run_date"), "yyyy-MM-dd"))
        error = (
            F.when(v.isNull(), "the record cannot be read")
            .when(~F.coalesce(_str(v, "schema_version").isin(*schemas), F.lit(False)), "unsupported schema")
            .when(date.isNull(), "invalid run date")
            .when(~(_filled(v, "environment") & _filled(v, "models") & _filled(v, "source")), "missing run provenance")
            .when(~F.coalesce(F.size(listed) > 0, F.lit(False)), "a nonempty files mapping is required")
            .when(~F.coalesce(F.array_sort(F.map_keys(cases)) == F.array(*map(F.lit, sorted(case_names))), F.lit(False)), "the cases differ from those expected")
        )
        self.row = one.select("v", listed.alias("listed"), cases.alias("cases"), error.alias("error"), _str(v, "schema_version").alias("schema_version"))
        self.read = check(self.row, F.lit(check_id), F.col("error"))
        good = self.row.filter("error is null")
        spec = good.select(F.explode("listed").alias("path", "s"))
        self.manifest = spec.select("path", _int(F.col("s"), "bytes").alias("bytes"), _str(F.col("s"), "sha256").alias("sha256"))
        self.cases = good.select("schema_version", F.map_keys("listed").alias("listed"), F.explode("cases").alias("case", "c"))

    def case_checks(self, flags: tuple[str, ...], paths: tuple[str, ...], more: Column | None = None, extra: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The checks case_paths:<case>, and the cases that pass, with paths as columns and images."""
        c = F.col("c")
        images = _strings(c, "render_pngs")
        every = F.concat(F.array(*[_str(c, p) for p in paths]), images, extra if extra is not None else F.array().cast("array<string>"))
        outside = F.exists(every, lambda p: ~path_ok(p))
        absent = F.exists(every, lambda p: ~F.array_contains(F.col("listed"), p))
        rules = [(_bool(c, f).isNull(), f"{f} must be a recorded boolean") for f in flags]
        rules += [(more, "text_line_count must be a nonnegative integer")] if more is not None else []
        rules += [
            (F.coalesce(_str(c, "visual_acceptance"), F.lit("")) == "", "a recorded visual-review status is required"),
            (_strings(c, "observations").isNull(), "observations must be a list of strings"),
            (~F.coalesce(F.size(images) > 0, F.lit(False)), "at least one saved render is required"),
            (F.exists(every, lambda p: p.isNull()), "a case path is missing"),
            (outside, "evidence path must stay inside the package"),
            (absent, "case evidence is absent from files"),
        ]
        error = F.coalesce(*[F.when(F.coalesce(r, F.lit(True)), F.lit(m)) for r, m in rules])
        judged = self.cases.withColumn("case_error", error)
        good = judged.filter("case_error is null").select("case", "schema_version", "c", images.alias("images"), *[_str(c, p).alias(p) for p in paths])
        return check(judged, F.concat(F.lit("case_paths:"), "case"), F.col("case_error")), good


def signatures(cases: DataFrame, files: DataFrame) -> DataFrame:
    """render_signature:<case>:<path> of each saved render."""
    pdf = cases.select("case", F.col("render_pdf").alias("path"), F.lit("pdf").alias("kind"))
    png = cases.select("case", F.explode("images").alias("path"), F.lit("png").alias("kind"))
    both = pdf.unionByName(png).join(files, "path", "left")
    good = F.when(F.col("kind") == "pdf", has_signature(F.col("content"), "pdf")).otherwise(has_signature(F.col("content"), "png"))
    return check(both, F.concat_ws(":", F.lit("render_signature"), "case", "path"), F.when(~good, "invalid saved render signature"))


def documents_of(cases: DataFrame, files: DataFrame, column: str) -> DataFrame:
    text = F.col("content").cast("string")
    return cases.select("case", F.col(column).alias("path")).join(files, "path", "left").select("case", F.from_json(text, DOCUMENT).alias("d"))


def table_checks(cases: DataFrame, files: DataFrame, column: str, saved: str, truth_path: str, check_id: str, respect_errors: bool) -> DataFrame:
    """Recompute the table score of each case that saved one, and compare it."""
    truth_ddl = "rows int, cols int, physical_cell_count int, merged_cell_count int, cells array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>"
    scored = cases.withColumn("saved", _str(F.col("c"), saved)).filter("saved is not null")
    truth = files.filter(F.col("path") == truth_path).select(F.from_json(F.col("content").cast("string"), truth_ddl).alias("t"))
    held = scored.select(F.col("case").alias("table_id")).crossJoin(truth)  # one truth table
    tables = held.select("table_id", "t.rows", "t.cols", "t.physical_cell_count", "t.merged_cell_count")
    cells = held.select("table_id", F.posexplode("t.cells").alias("pos", "x")).select("table_id", "pos", "x.*")
    docs = documents_of(scored, files, column)
    found = F.filter(F.transform(F.flatten(F.transform("d.pages", lambda p: p["blocks"])), lambda b: b["table"]), lambda t: t.isNotNull())
    ok = F.coalesce(F.size("d.errors") == 0, F.lit(False)) if respect_errors else F.lit(True)
    scores = score_responses(tables, cells, docs.select(F.col("case").alias("table_id"), ok.alias("success"), found.alias("tables")))
    recorded = scored.select("case", F.col("saved").alias("path")).join(parsed(files), "path", "left")
    at = {"true_positive": "merges.true_positive", "false_positive": "merges.false_positive", "false_negative": "merges.false_negative"}
    recorded = recorded.select(F.col("case").alias("table_id"), *[F.try_variant_get("v", f"$.{at.get(k, k)}", "double").alias(f"r_{k}") for k in SCORES])
    both = scores.join(recorded, "table_id", "left")
    same = reduce(lambda a, b: a & b, [F.col(k).cast("double").eqNullSafe(F.col(f"r_{k}")) for k in SCORES])
    error = F.coalesce("error", F.when(~same, "the recomputed table score differs from the saved one"))
    return check(both, F.concat(F.lit(f"{check_id}:"), "table_id"), error)


def verify_local(files: DataFrame, record_path: str, truth_path: str = "artifacts/merged-table-ground-truth.json", schemas=("local-showcase-evidence-v1",), case_names=("merged-table", "plos")) -> DataFrame:
    """Checks of a local run record: identities, case records, recounted lines, Word files, table scores, renders."""
    rec = Record(files, record_path, schemas, "read_local_run", case_names)
    c = F.col("c")
    lines = _int(c, "text_line_count")
    score = F.when(_str(c, "table_score").isNotNull(), F.array(_str(c, "table_score"), F.lit(truth_path))).otherwise(F.array().cast("array<string>"))
    shapes, cases = rec.case_checks(("ocr_executed", "docx_generated"), PATHS_LOCAL, ~F.coalesce(lines >= 0, F.lit(False)), score)
    counted = documents_of(cases, files, "json").select("case", text_line_count(F.col("d.pages")).alias("n")).join(cases.select("case", lines.alias("said")), "case")
    wrong = F.when(F.col("n").isNull(), "pipeline text lines cannot be counted").when(F.col("n") != F.col("said"), F.format_string("text_line_count: recorded %d, actual %d", F.col("said"), F.col("n")))
    word = cases.select("case", F.col("docx").alias("path")).join(inspect_word(files.join(cases.select(F.col("docx").alias("path")).distinct(), "path", "left_semi")), "path", "left")
    return union([
        rec.read,
        file_checks(rec.manifest, identities(files)),
        shapes,
        check(counted, F.concat(F.lit("text_line_count:"), "case"), wrong),
        check(word, F.concat(F.lit("docx_readable:"), "case"), F.coalesce("error", F.when(F.col("tables").isNull(), "missing Word file"))),
        table_checks(cases, files, "json", "table_score", truth_path, "table_score", True),
        signatures(cases, files),
    ])


def verify_translation(files: DataFrame, record_path: str, truth_path: str = "artifacts/merged-table-ground-truth.json", case_names=("merged-table", "plos")) -> DataFrame:
    """Checks of a translation run record; its faithful form adds the layout's acceptance rules."""
    plain, faithful = "translation-showcase-evidence-v1", "faithful-translation-showcase-evidence-v1"
    rec = Record(files, record_path, (plain, faithful), "read_translation_run", case_names)
    shapes, cases = rec.case_checks(("translation_executed", "docx_generated"), PATHS_TRANSLATION)
    c = F.col("c")

    def coverage(column: str, name: str) -> DataFrame:
        docs = documents_of(cases, files, column).select(F.col("case").alias("doc_id"), F.col("d.pages").alias("pages"))
        return translation_coverage(docs).select(F.col("doc_id").alias("case"), F.col("page_count").alias(f"{name}_pages"), F.col("translated_entries_with_script").alias(f"{name}_entries"))

    text = coverage("source_json", "s").join(coverage("translated_json", "t"), "case")
    text_error = F.when(~F.coalesce(F.col("s_pages") > 0, F.lit(False)) | ~F.coalesce(F.col("t_pages") > 0, F.lit(False)), "expected nonempty pipeline pages").when(F.col("s_pages") != F.col("t_pages"), "the page count differs from the source").when(F.col("t_entries") == 0, "no translated text in the target script")
    data = parsed(files)
    logs = cases.select("case", F.col("model_responses").alias("path")).join(data, "path", "left")
    request = F.explode_outer(F.try_variant_get("v", "$.requests", "array<variant>"))
    shown = logs.select(F.col("case").alias("log_id"), (F.coalesce(_str(F.col("v"), "model"), F.lit("")) == "").alias("nameless"), (F.coalesce(_str(F.col("v"), "revision"), F.lit("")) == "").alias("unversioned"), (~_filled(F.col("v"), "generation")).alias("bare"))
    rows = logs.select(F.col("case").alias("log_id"), request.alias("r")).select("log_id", _str(F.col("r"), "request.source").alias("source"), _str(F.col("r"), "request.target").alias("target"), F.try_variant_get("r", "$.request.q", "variant").alias("q"), F.try_variant_get("r", "$.response.translatedText", "variant").alias("translated"))
    spoken = shown.join(response_counts(rows), "log_id", "left")
    spoken_error = F.coalesce(F.when(F.col("nameless") | F.col("unversioned"), "missing model provenance"), F.when(F.col("bare"), "missing generation parameters"), "error")
    word = cases.select("case", "schema_version", F.col("docx").alias("path")).join(inspect_word(files.join(cases.select(F.col("docx").alias("path")).distinct(), "path", "left_semi")), "path", "left")
    need = (F.col("case") == "merged-table") & (F.col("schema_version") == plain)
    word_error = F.coalesce("error", F.when(~F.coalesce(F.col("han") > 0, F.lit(False)), "no native text of the target script").when(need & ~F.coalesce((F.col("tables") > 0) & (F.col("table_han") > 0), F.lit(False)), "the table case needs a native table with text of the target script"))
    ran = cases.select("case", "schema_version", "c", "docx", F.col("execution").alias("path")).join(data.withColumnRenamed("v", "e"), "path", "left").drop("path")
    ran = ran.join(cases.select("case", F.col("render_audit").alias("path")).join(data.withColumnRenamed("v", "a"), "path", "left").drop("path"), "case")
    e, a = F.col("e"), F.col("a")
    agree = reduce(lambda x, y: x & y, [F.coalesce(_bool(e, k) == _bool(c, k), F.lit(False)) for k in ("translation_executed", "docx_generated")])
    turned = F.coalesce((_str(e, "translation_parameters.source_lang") == "en") & (_str(e, "translation_parameters.target_lang") == "zh"), F.lit(False))
    audited = F.coalesce(F.schema_of_variant(a).startswith("OBJECT<") & (F.schema_of_variant(a) != "OBJECT<>"), F.lit(False))
    ran_error = F.when(~agree, "case and execution statements differ").when(~turned, "execution parameters are not of the expected direction").when(~audited, "the render audit must be a nonempty object")
    full = ran.filter(F.col("schema_version") == faithful)
    full = full.join(word.select("case", "frames", "fonts", F.col("error").alias("word_error")), "case").join(identities(files).select(F.col("path").alias("docx"), F.col("sha256").alias("docx_digest")), "docx", "left")
    accepted = _str(a, "visual_review.acceptance")
    passed = accepted == "passed_for_page_layout"
    plans = F.try_variant_get(a, "$.layout.page_plans", "array<variant>")
    erased = F.exists(plans, lambda p: F.coalesce(F.to_json(F.try_variant_get(p, "$.failed_erase_regions", "variant")), F.lit("null")).isin("0", "[]", "null", "false") == F.lit(False))
    violations = F.coalesce(F.to_json(F.try_variant_get(a, "$.report.violations", "variant")), F.lit("null"))
    clean = reduce(lambda x, y: x & y, [F.coalesce(~_bool(a, f"visual_review.{k}"), F.lit(False)) for k in CLEAN_REVIEW])
    rules = [
        (_str(e, "renderer_confirmed").eqNullSafe(F.lit("FaithfulWordBuilder")), "the faithful renderer was not confirmed"),
        (_bool(e, "translation_parameters.runtime_options._faithful_layout") & _bool(e, "translation_parameters.runtime_options._preserve_block_boundaries"), "translation did not use faithful grouping"),
        (_str(a, "docx_sha256") == F.col("docx_digest"), "the audit belongs to a different Word file"),
        (accepted == _str(c, "visual_acceptance"), "case and visual review disagree"),
        (F.col("word_error").isNull() & (F.col("frames") > 0) & (F.col("fonts") > 0), "a faithful Word file needs native frames and embedded fonts"),
        (_str(a, "layout.font_embedding.status") == "success", "font embedding is not verified"),
        (~passed | (_bool(a, "report.passed") & violations.isin("null", "[]", "{}", "0", "false", '""')), "an accepted layout requires a passing delivery audit"),
        (~passed | ((_int(a, "layout.failed_region_count") == 0) & ~erased), "failed layout regions cannot be presented as accepted"),
        (~passed | clean, "an accepted layout requires an explicit clean visual review"),
        (~passed | F.try_variant_get(a, "$.visual_review.rendered_pages", "long").eqNullSafe(F.try_variant_get(a, "$.visual_review.source_pages", "long")), "an accepted layout changed the page count"),
    ]
    full_error = F.coalesce(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(m)) for r, m in rules])
    named = lambda x: F.concat(F.lit(f"{x}:"), F.col("case"))
    return union([
        rec.read,
        file_checks(rec.manifest, identities(files)),
        shapes,
        check(text, named("translated_text"), text_error),
        check(spoken, F.concat(F.lit("model_responses:"), "log_id"), spoken_error),
        check(word, named("docx_chinese"), word_error),
        check(ran, named("execution_record"), ran_error),
        table_checks(cases, files, "source_json", "source_table_score", truth_path, "source_table_score", False),
        check(full, named("faithful_evidence"), full_error),
        signatures(cases, files),
    ])


def verify_publication(files: DataFrame, manifest_path: str, provenance_path: str = "CODE_PROVENANCE.json") -> DataFrame:
    """One row: passed, reviewed_files, total_bytes, errors of a package against its allow-list."""
    one = parsed(files.filter(F.col("path") == manifest_path)).select(F.explode(F.try_variant_get("v", "$.files", "map<string,variant>")).alias("path", "s"))
    manifest = one.select("path", _int(F.col("s"), "bytes").alias("bytes"), _str(F.col("s"), "sha256").alias("sha256"))
    pages = files.filter(suffix(F.col("path")) == "md").join(manifest.select("path"), "path", "left_semi").select("path", F.col("content").cast("string").alias("text"))
    rows = parsed(files.filter(F.col("path") == provenance_path)).select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("r"))
    said = rows.select(_str(F.col("r"), "example").alias("path"), _str(F.col("r"), "example_sha256").alias("sha256"))
    errors = union([
        publication_errors(files, manifest),
        link_errors(pages, files.select("path")).select("path", F.concat_ws(": ", "error", "target").alias("error")),
        unlisted(files, manifest, manifest_path).select("path", F.lit("not in the explicit publication allowlist").alias("error")),
        provenance_mismatches(said, identities(files)).select("path", F.lit("provenance hash mismatch").alias("error")),
    ])
    return publication_report(errors, manifest, files)


# ---------------------------------------------------------------- recomputed scores
def score_scenes(rows: DataFrame, cases: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics by (scene, kind); timings by (scene, kind) with review counts; and integrity checks of the three tables."""
    metrics = aggregate_regions(rows, "scene", "kind")
    times = cases.groupBy("scene", "kind").agg(*timing("seconds"), F.max("gpu_memory.max_device_used_mib").alias("device_memory_max_mib"), F.count_if("page_needs_review").alias("page_needs_review_count"))
    counts = rows.groupBy("scene", "kind").agg(F.count_if("exact").alias("exact"), F.count_if(~F.col("found")).alias("missed"), F.count_if("needs_review").alias("review_regions"))
    dim = sources.select(F.col("id").alias("sample_id"), F.col("kind").alias("s_kind"), "selected_regions", "image_sha256")
    held = rows.groupBy("scene", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"), F.min("kind").alias("r_kind"))
    joined = cases.join(dim, "sample_id", "left").join(held, ["scene", "sample_id"], "left")
    error = (
        F.when(F.col("s_kind").isNull(), "source/request mismatch")
        .when(~F.col("n").eqNullSafe(F.col("selected_regions")), "per-page region count mismatch")
        .when(F.col("input_sha256") != F.col("image_sha256"), "input hash mismatch")
        .when((F.col("kind") != F.col("s_kind")) | (F.col("kinds") != 1) | (F.col("r_kind") != F.col("s_kind")), "drawing category mismatch")
    )
    checks = check(joined, F.concat_ws(":", F.lit("case"), "scene", "sample_id"), error)
    twice = lambda df, name, *keys: check(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("k")), F.lit(name), F.when(F.col("k") > 1, "duplicate"))
    checks = union([checks, twice(rows, "unique_region_scores", "scene", "sample_id", "id"), twice(cases, "unique_requests", "scene", "sample_id"), twice(sources, "unique_sources", "id")])
    return metrics, times.join(counts, ["scene", "kind"], "left"), checks


def score_stages(rows: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Metrics by (stage, scene, kind) against published ones."""
    return against_baseline(aggregate_regions(rows, "stage", "scene", "kind"), expected, ["stage", "scene", "kind"], fields)


def score_suites(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage, group, exact, n, cer) of routed bundle rows, and (stage, sample_id, n, found, exact) of cell targets that have rows."""
    groups = route_bundles(rows).groupBy("stage", "group").agg(*micro_error_rate())
    targets = rows.filter((F.col("suite") == "pages") & F.array_contains(F.coalesce("cell_target_ids", F.array().cast("array<string>")), F.col("id")))
    return groups, targets.groupBy("stage", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found_in_valid_cells"), F.count_if("exact").alias("exact"))


def rollup(checks: DataFrame) -> DataFrame:
    return check_rollup(checks)
