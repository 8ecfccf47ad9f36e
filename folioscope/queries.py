"""The operators on the driver's tables: each query adapts whole tables to an operator's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import literals, text
from folioscope.operators import evidence, geometry, integrity, layout, metrics, policy, routing, tables, tolerance, translation
from folioscope.sources import readers

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modulo(c: str, n: int):
    return F.col(c) % n


def spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of few bytes and much work on all cores: a scan parts its tasks by bytes and row groups, so that a small file of many rows is one task."""
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- routing
def pages_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))


def routed(docs: DataFrame, path, requested, output_format) -> DataFrame:
    rows = docs.select("doc_id", path.alias("path"), requested.alias("requested"), output_format.alias("fmt")).join(routing.page_metrics(pages_of(docs)), "doc_id")
    return routing.route(rows, F.col("path"), F.col("requested"), F.col("fmt")).withColumn("warnings", F.array_join("warnings", ","))


@query
def doc_routing(spark, sf):
    return routed(load(spark, sf, "documents"), F.lit("a.pdf"), F.lit("auto"), F.lit("docx"))


@query
def routing_guards(spark, sf):
    d = load(spark, sf, "documents")
    asked = F.array(F.lit(" AUTO"), F.lit("native"), F.lit("ocr-word"), F.lit(None), F.lit("weird"), F.lit("Text"), F.lit("ocr"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.when(modulo("doc_id", 5) == 0, ".txt").when(modulo("doc_id", 5) == 1, ".PDF").otherwise(".pdf"))
    return routed(d, path, F.get(asked, (F.col("doc_id") % 7).cast("int")), F.when(modulo("doc_id", 11) == 0, "pptx").otherwise(" DOCX"))


@query
def mode_normalize(spark, sf):
    asked = F.array(*map(F.lit, ("auto", " Native ", "PDF", "pdf_to_word", "pdf-to-word", "ocr_word", "OCR", "", "  ", "other", "text", "direct")))
    rows = load(spark, sf, "events").select(F.get(asked, (F.col("event_id") % 12).cast("int")).alias("asked"))
    return rows.groupBy(routing.conversion_mode(F.col("asked")).alias("mode"), "asked").agg(F.count(F.lit(1)).alias("n"))


@query
def settings_override(spark, sf):
    raw = F.when(modulo("event_id", 4) == 0, "0").when(modulo("event_id", 4) == 1, "12").when(modulo("event_id", 4) == 2, "many")
    return load(spark, sf, "events").groupBy(routing.setting(raw, 6).alias("warn_pages")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_metrics(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", text.ink_length("text").cast("long").alias("ink"), F.length(text.normalize("text")).cast("long").alias("normal_length"), F.md5(text.normalize("text").cast("binary")).alias("normal_md5"), text.critical_count("text").cast("long").alias("critical"), F.regexp_count("text", F.lit(text.HAN)).cast("long").alias("han"))


# ---------------------------------------------------------------- metrics
def region_rows(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    whole = lambda e: e.cast("int")
    return d.select(
        F.col("source").alias("scene"), F.col("lang").alias("kind"), F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("exact"), (F.col("toxic") == 1).alias("needs_review"), (modulo("doc_id", 7) != 0).alias("found"),
        whole(modulo("n_chars", 13)).alias("edits"), whole(modulo("n_chars", 97)).alias("reference_characters"), whole(modulo("doc_id", 3)).alias("critical_errors"), whole(modulo("doc_id", 5)).alias("critical_characters"),
    )


@query
def region_aggregate(spark, sf):
    return metrics.aggregate_regions(region_rows(spark, sf), "scene", "kind")


@query
def region_rollup(spark, sf):
    return metrics.rollup_regions(region_rows(spark, sf), "scene", "kind").withColumn("level", F.col("level").cast("long"))


@query
def micro_cer(spark, sf):
    return region_rows(spark, sf).groupBy("scene").agg(*metrics.micro_error_rate())


@query
def page_review_count(spark, sf):
    return region_rows(spark, sf).groupBy("scene").agg(F.count_if("needs_review").alias("page_needs_review_count"))


@query
def semantic_coverage(spark, sf):
    return translation.semantic_coverage(region_rows(spark, sf).select("kind", F.col("found").alias("required"), F.col("exact").alias("preserved")), "kind")


@query
def frozen_baseline(spark, sf):
    """Measured metrics against the same ones from half of the scenes: what agrees, differs or is missing."""
    rows = region_rows(spark, sf)
    expected = metrics.aggregate_regions(rows.filter(F.col("scene") < "src5"), "scene", "kind")
    return metrics.against_baseline(metrics.aggregate_regions(rows, "scene", "kind"), expected, ["scene", "kind"], ["regions", "cer", "miss_rate"], 1e-12)


@query
def scene_timing(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(*metrics.timing("value")).drop("total_seconds")


@query
def request_percentiles(spark, sf):
    e = load(spark, sf, "events").select("user_id", F.col("value").alias("seconds"), (modulo("event_id", 10) == 0).alias("warmup"), (F.col("event_type") != "error").alias("success"))
    return metrics.request_summary(e, "user_id")


@query
def duplicate_guard(spark, sf):
    return metrics.duplicates(load(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "source"), "digest", "source")


@query
def check_rollup(spark, sf):
    p = load(spark, sf, "pages")
    return metrics.check_rollup(p.select((modulo("page_id", 4)).alias("record"), F.col("html").rlike("<a href").alias("passed")), "record")


# ---------------------------------------------------------------- edits
def turn_pairs(spark, sf) -> DataFrame:
    line = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("reference"), F.lead("text").over(line).alias("prediction"))
    return spread(spark, c.filter("prediction is not null"))


@query
def edit_distance(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", text.edit_distance("reference", "prediction").cast("long").alias("edits"))


@query
def critical_edits(spark, sf):
    e = turn_pairs(spark, sf).withColumn("e", text.edit_counts("reference", "prediction"))
    return e.select("conv_id", "turn", F.col("e.edits").cast("long").alias("edits"), F.col("e.critical_errors").cast("long").alias("critical_errors"))


@query
def critical_count(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", text.critical_count("text").cast("long").alias("critical"))


@query
def compact_cer(spark, sf):
    """Error rates without spaces (documented variant)."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    p = turn_pairs(spark, sf).select(bare("reference").alias("r"), bare("prediction").alias("p"))
    return p.agg(F.count_if(F.col("r") == F.col("p")).alias("exact"), F.sum(F.levenshtein("r", "p")).cast("long").alias("edits"), F.sum(F.length("r")).cast("long").alias("characters"))


# ---------------------------------------------------------------- tables
def lines_in_order(spark, sf) -> DataFrame:
    """All lines, numbered anew within their order, as orders repeat line numbers."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return load(spark, sf, "lineitem").withColumn("l_linenumber", F.row_number().over(line))


def table_rows(spark, sf, shift: int = 0, in_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """Orders as tables of two columns, their lines as cells; every ninth part ends one column further."""
    l = lines_in_order(spark, sf) if in_order else load(spark, sf, "lineitem")  # noqa: E741
    n = F.col("l_linenumber") - 1
    cells = l.select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("pos"), F.floor(n / 2).cast("int").alias("row"), (n % 2).cast("int").alias("col"), F.lit(1).alias("rowspan"),
        F.when(F.col("l_partkey") % 9 == shift, 2).otherwise(1).alias("colspan"), F.concat_ws("  ", "l_returnflag", F.when(F.col("l_suppkey") % 7 == shift, "x"), F.col("l_linestatus")).alias("text"),
    )
    heads = cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows")).withColumn("cols", F.lit(2))
    return heads, cells


@query
def table_validate(spark, sf):
    return tables.validate_cells(*table_rows(spark, sf, in_order=False))


@query
def table_score(spark, sf):
    (_, truth), (_, found) = table_rows(spark, sf), table_rows(spark, sf, 1)
    moved = found.withColumn("row", F.when(F.col("pos") == 3, F.col("row") + 500).otherwise(F.col("row")))  # a cell that no true one matches
    return tables.score_tables(truth, moved)


def boxes(spark, sf) -> DataFrame:
    e = load(spark, sf, "embeddings")
    v = lambda i: (F.col("embedding")[i].cast("double") + 1) * 400
    return e.select("vec_id", F.array(v(0), v(1), v(0) + F.abs(v(2)) / 2, v(1) + F.abs(v(3)) / 2 - 40).alias("bbox"))


@query
def box_valid(spark, sf):
    return boxes(spark, sf).select("vec_id", geometry.box_valid(F.col("bbox"), 640, 600).alias("valid"))


@query
def box_scale(spark, sf):
    s = boxes(spark, sf).withColumn("b", geometry.scale_box(F.col("bbox"), 2000, 1500))
    return s.select("vec_id", F.get("b", F.lit(0)).alias("x1"), F.get("b", F.lit(3)).alias("y2"))


@query
def table_geometry(spark, sf):
    """Grids of one column from orders; a cell in seven has an edge off by a little, one in eleven by more than is allowed; lines with one number lie upon each other."""
    l = load(spark, sf, "lineitem")  # noqa: E741
    top = (F.col("l_linenumber") - 1) * 100.0
    off = F.when(F.col("l_partkey") % 11 == 0, 30.0).when(F.col("l_partkey") % 7 == 0, 1.0).otherwise(0.0)
    cells = l.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") - 1).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.array(F.lit(0.0), top, F.lit(100.0), top + 100 - off).alias("bbox"))
    heads = cells.groupBy("table_id").agg(F.max("pos").alias("rows")).withColumn("cols", F.lit(1)).withColumn("bbox", F.array(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.col("rows") * 100.0))
    return geometry.table_topology(heads, cells)


# ---------------------------------------------------------------- policy
def risks(c):
    names = ("low_confidence", "critical_engineering_annotation", "formula_unverified", "letter_digit_confusable", "dimension_symbol_completeness_unverified", "other")
    return F.filter(F.array(*[F.when(F.shiftright(c, i) % 2 == 1, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


@query
def risk_priority(spark, sf):
    e = load(spark, sf, "events").select("event_id", policy.risk_priority(risks((F.col("event_id") % 64).cast("int"))).alias("priority"))
    return e.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("long").alias("ids"))


@query
def scheduled_topk(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", policy.risk_priority(risks((F.col("event_id") % 64).cast("int"))).alias("priority"))
    return policy.schedule(e, "user_id", "priority", "event_id", 16).select("user_id", "event_id", "priority", F.col("rank").cast("long").alias("rank"))


def outputs(spark, sf) -> DataFrame:
    c = load(spark, sf, "conversations")
    k = F.col("turn") + F.col("conv_id")
    said = F.when(k % 9 == 0, "").when(k % 9 == 1, "Here is it").when(k % 9 == 2, F.concat(F.lit("```"), "text")).when(k % 9 == 3, F.concat(F.lit("{"), "text", F.lit("}"))).when(k % 9 == 4, F.concat(F.lit("}{"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", said.alias("text"), F.when(k % 13 == 0, "timeout").when(k % 17 != 0, "ok").alias("status"), (k % 19 == 0).alias("truncated"), F.when(k % 23 == 0, "length").alias("finish"), F.when(k % 2 == 0, "formula").otherwise("text").alias("task"))


@query
def output_valid(spark, sf):
    o = outputs(spark, sf)
    return o.select("conv_id", "turn", policy.output_status(*map(F.col, ("status", "text", "truncated", "finish", "task"))).alias("verdict"))


@query
def weight_identity(spark, sf):
    c = load(spark, sf, "customer")
    k = F.col("c_custkey") % 6
    field = lambda n, *when: F.when(k.isin(*when), F.col("c_name")).alias(n)
    model = F.struct(field("weight_identity", 0), field("weights_sha256", 1), F.lit("").alias("weight_sha256"), field("id", 2, 3), field("model_id", 4), F.when(k == 2, "r1").alias("revision"), F.when(k == 4, "r2").alias("commit_hash"))
    return c.select("c_custkey", policy.weight_identity(model).alias("identity"))


@query
def critical_change(spark, sf):
    return turn_pairs(spark, sf).select("conv_id", "turn", policy.critical_change(F.col("reference"), F.col("prediction"), F.when(modulo("turn", 5) == 0, "formula").otherwise("text")).alias("changed"))


# ---------------------------------------------------------------- evidence
def evidence_tables(spark, sf):
    d, c = load(spark, sf, "documents"), load(spark, sf, "conversations")
    regions = d.select((modulo("doc_id", 10)).alias("report_id"), F.col("doc_id").alias("region_id"), (modulo("doc_id", 4) == 0).alias("needs_review"), F.lit("open").alias("resolution"))
    none = F.lit(None).cast("string")
    had = d.filter(modulo("doc_id", 3) == 0).select((modulo("doc_id", 10)).alias("report_id"), F.col("doc_id").alias("region_id"), F.lit(0).alias("pos"), F.concat(modulo("doc_id", 90).cast("string"), F.lit(".5")).alias("text"), F.lit("ok").alias("status"), none.alias("reason"), F.lit("ocr").alias("source"), F.lit(0.5).alias("confidence"))
    region = F.col("conv_id") * 3
    seen = c.select((region % 10).alias("report_id"), F.col("turn").cast("int").alias("pos"), region.alias("region_id"), F.concat(F.when(modulo("turn", 3) == 0, "+").otherwise(""), (F.col("conv_id") % 50 + F.floor(F.col("turn") / 2)).cast("string")).alias("text"), F.when(modulo("turn", 5) == 4, "timeout").otherwise("ok").alias("status"), none.alias("reason"))
    return regions, had, seen


@query
def evidence_attach(spark, sf):
    regions, candidates, _ = evidence.attach(*evidence_tables(spark, sf))
    listed = candidates.groupBy("report_id", "region_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("/", "text", "status", "source").alias("t")))), lambda x: x["t"]), ";").alias("candidates"))
    return regions.join(listed, ["report_id", "region_id"], "left")


@query
def evidence_propagate(spark, sf):
    regions, _, _ = evidence.attach(*evidence_tables(spark, sf))
    owners = load(spark, sf, "pages").select((modulo("page_id", 10)).alias("report_id"), F.col("page_id").alias("region_id"), F.lit(False).alias("needs_review"), F.lit("owner").alias("resolution"))
    return evidence.propagate(owners, regions)


@query
def evidence_rejected(spark, sf):
    return evidence.attach(*evidence_tables(spark, sf))[2]


@query
def annotation_compose(spark, sf):
    regions, candidates, _ = evidence.attach(*evidence_tables(spark, sf))
    parts = regions.select(F.floor(F.col("region_id") / 3).cast("long").alias("group_id"), (F.col("region_id") % 3).cast("int").alias("part"), F.lit("r").alias("role"), "region_id", F.array(F.concat(modulo("region_id", 7).cast("string"), F.lit(".0")), F.lit("1")).alias("observed"))
    made = evidence.compose(parts, candidates.drop("report_id"))
    return made.select("group_id", F.array_join("reviewed_candidates", ";").alias("reviewed_candidates"), F.array_join("unreviewed_part_ids", ",").alias("unreviewed"), "review_status")


@query
def candidate_upper_bound(spark, sf):
    _, candidates, _ = evidence.attach(*evidence_tables(spark, sf))
    d = load(spark, sf, "documents").select((modulo("doc_id", 10)).alias("report_id"), F.col("doc_id").alias("region_id"), F.concat(modulo("doc_id", 45).cast("string"), F.lit(".5")).alias("reference"))
    return evidence.candidate_upper_bound(candidates, d)


@query
def paired_changes(spark, sf):
    r = region_rows(spark, sf)
    return evidence.paired_changes(r.select(F.col("id").alias("region_id"), "kind", "exact"), r.select(F.col("id").alias("region_id"), F.col("found").alias("exact")), "kind")


@query
def budget_share(spark, sf):
    """Share of regions beyond the reading budget (documented measure)."""
    r = region_rows(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("scene").orderBy("id")))
    return r.groupBy("scene").agg(F.count_if(F.col("rank") > 16).alias("exhausted"), (F.count_if(F.col("rank") > 16) / F.count(F.lit(1))).alias("share"))


# ---------------------------------------------------------------- literals
def plans(spark, sf) -> DataFrame:
    """Two spans in each text: characters 3 to 7, and 10 to 10 + n of twenty."""
    d = load(spark, sf, "documents").select("doc_id", F.col("text").alias("t"))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), b.cast("int").alias("end"))
    spans = F.array(span(10, 10 + modulo("doc_id", 20)), span(3, F.lit(7)))
    return d.withColumn("plan", literals.protect(F.col("t"), spans))


@query
def literal_protect(spark, sf):
    return plans(spark, sf).select("doc_id", "plan.request", F.array_join("plan.tokens", ",").alias("tokens"), "plan.error")


@query
def literal_restore(spark, sf):
    p = plans(spark, sf).filter("plan.error is null").withColumn("r", literals.restore(F.col("plan"), F.concat(F.lit("<"), F.col("plan.request"), F.lit(">"))))
    return p.select("doc_id", F.col("r.text").alias("restored"), F.col("r.ok").alias("ok"), (F.col("r.text") == F.concat(F.lit("<"), "t", F.lit(">"))).alias("whole"))


@query
def literal_restore_fail(spark, sf):
    t = F.col("plan.tokens")
    swapped = F.concat(t[1], F.lit(" and "), t[0])
    k = F.col("doc_id") % 4
    back = F.when(k == 0, t[0]).when(k == 1, F.concat(t[0], t[0], t[1])).when(k == 2, swapped).otherwise(F.concat(F.replace(t[0], F.lit("_0_"), F.lit("_7_")), t[1]))
    p = plans(spark, sf).filter("plan.error is null").withColumn("back", back)
    return p.select("doc_id", literals.restore(F.col("plan"), F.col("back"))["ok"].alias("strict"), literals.restore(F.col("plan"), F.col("back"), True)["ok"].alias("any_order"))


# ---------------------------------------------------------------- layout
@query
def char_width(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", text.character_width("p_name", 10.0, 0.52).alias("width"), text.line_width("p_name", 10.0, 0.5).alias("allowed"))


@query
def wrapped_lines(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", text.wrapped_lines("p_name", F.col("p_size").cast("double"), 11.0, 0.52).cast("long").alias("lines"))


def fit_boxes(spark, sf) -> DataFrame:
    p = spread(spark, load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), (F.col("p_size") * 6).cast("double").alias("width_pt"), (10 + modulo("p_partkey", 40)).cast("double").alias("height_pt"), (8 + modulo("p_partkey", 5)).cast("double").alias("base_size"))


@query
def copy_fit_single(spark, sf):
    return layout.copy_fit_single(fit_boxes(spark, sf)).withColumn("line_count", F.col("line_count").cast("long"))


@query
def copy_fit_multi(spark, sf):
    return layout.rounded(layout.copy_fit(fit_boxes(spark, sf).withColumn("max_lines", F.lit(3))))


# ---------------------------------------------------------------- tolerances
def fragments(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A few fragments a drawing, around a nominal at the left; some angles and texts break the association."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 3).cast("long").alias("drawing_id"), (F.col("vec_id") % 3).cast("int").alias("pos"))
    j = F.col("embedding")[0].cast("double") * 10
    box = F.when(F.col("pos") == 0, F.array(F.lit(100.0), F.lit(100.0), F.lit(200.0), F.lit(150.0))).when(F.col("pos") == 1, F.array(205 + j, F.lit(93.0), F.lit(255.0), 115 + j)).otherwise(F.array(206 - j, 127 + j, F.lit(256.0), F.lit(150.0)))
    first = F.when(F.col("pos") == 0, F.concat(modulo("drawing_id", 30).cast("string"), F.lit(".5"))).when(F.col("pos") == 1, F.lit("+.003")).otherwise(F.when(modulo("drawing_id", 8) == 0, "R2").otherwise(".002"))
    f = e.select("drawing_id", "pos", F.col("vec_id").cast("string").alias("id"), F.when(modulo("vec_id", 4) == 1, F.array(first, F.lit("-1"))).otherwise(F.array(first)).alias("texts"), box.alias("bbox"), F.when(modulo("vec_id", 13) == 7, 90.0).otherwise(0.0).alias("angle"))
    cells = e.filter((F.col("pos") == 0) & (modulo("drawing_id", 5) == 0)).select("drawing_id", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.array(F.lit(90.0), F.lit(80.0), F.lit(202.0), F.lit(160.0)).alias("bbox")), F.struct(F.lit(1).alias("idx"), F.array(F.lit(0.0), F.lit(0.0), F.lit(500.0), F.lit(500.0)).alias("bbox")))).alias("c")).select("drawing_id", "c.*")
    return f, cells


@query
def tolerance_pairs(spark, sf):
    return tolerance.neighbour_pairs(*fragments(spark, sf))


@query
def tolerance_groups(spark, sf):
    g = tolerance.annotation_groups(*fragments(spark, sf))
    return g.select("drawing_id", "id", "candidate_text", F.array_join("observed_candidates", ";").alias("observed"), F.get("bbox", F.lit(2)).alias("x2"))


@query
def box_matches(spark, sf):
    """One-to-one matching by overlap (documented semantics)."""
    f, _ = fragments(spark, sf)
    moved = f.withColumn("bbox", F.transform("bbox", lambda v: v + 4.0))
    side = lambda x: x.select(F.col("drawing_id").alias("page_id"), F.lit("line").alias("kind"), "id", "bbox")
    return tolerance.match_boxes(side(f), side(moved))


# ---------------------------------------------------------------- integrity
def manifests(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents as files; the manifest knows three in four, with some digests changed, and some that are gone."""
    d = load(spark, sf, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    actual = integrity.identities(d.select(path.alias("path"), F.col("text").cast("binary").alias("content")))
    listed = actual.join(d.select(path.alias("path"), "doc_id"), "path").filter(modulo("doc_id", 4) != 0)
    listed = listed.select("path", F.when(modulo("doc_id", 9) == 1, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(modulo("doc_id", 10) == 1, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    gone = d.filter(modulo("doc_id", 50) == 0).select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return listed.unionByName(gone), actual


@query
def manifest_missing(spark, sf):
    return integrity.missing(*manifests(spark, sf))


@query
def manifest_changed(spark, sf):
    return integrity.changed(*manifests(spark, sf))


@query
def unlisted(spark, sf):
    listed, actual = manifests(spark, sf)
    return integrity.unlisted(actual, listed)


@query
def file_checks(spark, sf):
    return integrity.file_checks(*manifests(spark, sf))


@query
def provenance_mismatch(spark, sf):
    listed, actual = manifests(spark, sf)
    return integrity.provenance_mismatches(listed.select("path", F.lower("sha256").alias("sha256")), actual.withColumn("sha256", F.when(F.length("path") % 5 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))))


@query
def secret_scan(spark, sf):
    d = load(spark, sf, "documents")
    made = F.when(modulo("doc_id", 6) == 0, F.concat("text", F.lit(" AKIA"), F.upper(F.substring(F.md5("text"), 1, 16)))).otherwise(F.col("text"))
    return d.select("doc_id", text.has_secret(made).alias("secret"), text.is_digest(F.when(modulo("doc_id", 2) == 0, F.sha2("text", 256)).otherwise(F.md5("text"))).alias("digest"))


@query
def path_safety(spark, sf):
    bad = F.array(*map(F.lit, ("a/b", "/a", "a/../b", "a//b", "./a", "c:/x", "a\\b", "", "a/.", "x.json")))
    p = load(spark, sf, "pages").select("page_id", F.concat(F.get(bad, modulo("page_id", 10).cast("int")), F.when(modulo("page_id", 3) == 0, "/k").otherwise("")).alias("path"))
    return p.select("page_id", integrity.path_ok(F.col("path")).alias("canonical"), integrity.path_ok(F.col("path"), False).alias("relative"))


@query
def link_check(spark, sf):
    """Links of pages as Markdown, some to pages that are there, some to none."""
    p = load(spark, sf, "pages")
    path = F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".md"))
    to = lambda k: F.concat((F.col("page_id") + k).cast("string"), F.lit(".md"))
    body = F.concat(F.lit("see [a](../p/"), to(1), F.lit(") and ![b](<"), to(10), F.lit('> "t") or [c](https://x.org/a) [d](ftp://y) [e](#top) [f](../../up)'))
    pages = p.select(path.alias("path"), body.alias("text"))
    return integrity.link_errors(pages, pages)


@query
def set_ops(spark, sf):
    listed, actual = manifests(spark, sf)
    return integrity.same_sets(listed, actual, "path").withColumn("kind", F.lit("manifest")).unionByName(integrity.same_sets(actual, actual, "path").withColumn("kind", F.lit("self")))


# ---------------------------------------------------------------- nested documents
def nested(spark, sf) -> DataFrame:
    """Conversations as documents: a turn is a page, its sentences are lines; user turns have overlays, others a table."""
    c = load(spark, sf, "conversations")
    line = lambda t: F.struct(t.alias("text"), F.when(F.length(t) % 3 == 0, F.concat(t, F.lit("漢"))).when(F.length(t) % 3 == 1, F.lit(" ")).alias("translated_text"))
    lines = F.transform(F.split("text", r"\. "), line)
    cell = F.struct(F.concat("text", F.when(modulo("turn", 4) == 1, "字").otherwise("")).alias("text"), F.lit(None).cast("string").alias("translated_text"), F.struct(F.when(modulo("turn", 2) == 1, "表").alias("translated_text")).alias("raw"))
    block = F.struct(lines.alias("text_lines"), F.when(F.col("role") == "user", F.slice(lines, 1, 1)).alias("image_overlay_text"), F.when(F.col("role") != "user", F.struct(F.array(cell).alias("cells"))).alias("table"))
    page = c.select("conv_id", "turn", F.struct(F.array(block).alias("blocks")).alias("page"))
    # the order of pages does not matter to counts
    return page.groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list("page").alias("pages"))


@query
def line_counts(spark, sf):
    return nested(spark, sf).select("doc_id", translation.text_line_count(F.col("pages")).cast("long").alias("lines"))


@query
def translation_coverage(spark, sf):
    return translation.translation_coverage(nested(spark, sf))


@query
def response_log(spark, sf):
    """A log a conversation: single and listed requests, some with blanks, some the wrong way round."""
    c = load(spark, sf, "conversations")
    many = F.to_json(F.array(F.substring("text", 1, 4), F.expr("substring(text, 5)")))
    one = F.to_json(F.array("text"))
    alone = F.substring(one, F.lit(2), F.length(one) - 2)
    q = F.when(modulo("turn", 2) == 0, alone).otherwise(many)
    t = F.when(modulo("turn", 2) == 0, F.lit('"字"')).when(modulo("conv_id", 7) == 3, F.lit('["字", " "]')).otherwise(F.lit('["字", "b"]'))
    rows = c.select(F.col("conv_id").alias("log_id"), F.lit("en").alias("source"), F.when(modulo("conv_id", 11) == 5, "de").otherwise("zh").alias("target"), F.try_parse_json(q).alias("q"), F.try_parse_json(t).alias("translated"))
    return translation.response_counts(rows)


@query
def model_page_parse(spark, sf):
    """Pages of model output made from events: whole ones, fenced ones, bad boxes, bad topology, no objects."""
    e = spread(spark, load(spark, sf, "events").select("event_id"))
    k = F.col("event_id") % 8
    v = (F.col("event_id") % 90).cast("string")
    region = F.concat(F.lit('{"text":"r'), v, F.lit('","bbox":[0,0,'), F.when(k == 2, "1200").otherwise(F.concat(F.lit("1"), v)), F.lit(",500]}"))
    table = F.concat(F.lit('{"bbox":[0,0,100,100],"rows":1,"cols":2,"cells":[{"row":0,"col":0,"rowspan":1,"colspan":1,"bbox":[0,0,'), F.when(k == 3, "20").otherwise("50"), F.lit(',100],"text":"a"},{"row":0,"col":'), F.when(k == 4, "1.0").otherwise("1"), F.lit(',"rowspan":1,"colspan":1,"bbox":[50,0,100,100],"text":"b"}]}'))
    page = F.concat(F.lit('{"regions":['), region, F.lit('],"tables":'), F.when(k == 5, "null").otherwise(F.concat(F.lit("["), table, F.lit("]"))), F.lit("}"))
    raw = F.when(k == 1, F.concat(F.lit("```json\n"), page, F.lit("```"))).when(k == 6, F.concat(F.lit("x"), page)).when(k == 7, F.lit("[1]")).otherwise(page)
    pages = geometry.Pages(e.select(F.col("event_id").alias("page_id"), raw.alias("text"), F.lit(2000).alias("width"), F.lit(1000).alias("height")), keep=lambda parsed: parsed).pages  # one result, nothing to share
    return pages.select("page_id", "ok", F.col("lines").cast("long").alias("lines"), F.col("tables").cast("long").alias("tables"), "issues")


@query
def bundle_decode(spark, sf):
    """Lines of an order as rows of a score bundle, decoded and routed to groups."""
    l = load(spark, sf, "lineitem")  # noqa: E741
    s = lambda c: c.cast("string")
    row = F.array(s(F.col("l_linenumber")), s(F.col("l_quantity") > 25), s(F.col("l_tax") > 0.02), s(F.col("l_quantity").cast("int") % 7), s(F.col("l_quantity").cast("int")), F.lit("0"), F.lit("1"), F.lit("false"))
    k = F.col("l_orderkey") % 4
    suite = F.when(k == 0, "diagnostics").when(k == 1, "controls").when(k == 2, "regions").otherwise("pages")
    b = l.groupBy("l_orderkey", suite.alias("suite")).agg(F.collect_list(row).alias("rows"))
    kind = F.when(F.col("l_orderkey") % 3 == 0, "pid").otherwise("mechanical")
    b = b.select("l_orderkey", "suite", F.when(F.col("l_orderkey") % 8 < 4, "paddle").otherwise("mix").alias("stage"), F.lit("general").alias("scene"), kind.alias("kind"), F.lit("v").alias("view"), F.array(F.lit("c1"), kind).alias("categories"), "rows")
    rows = readers.route_bundles(readers.decode_bundles(b, F.array(*map(F.lit, readers.REGION_FIELDS))))
    return rows.groupBy("stage", "group").agg(*metrics.micro_error_rate())


@query
def map_flatten(spark, sf):
    """Nested maps of sums, built and taken apart again."""
    o = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    inner = o.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct("n", "top")))).alias("m"))
    whole = inner.agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "m"))).alias("runs"))
    return readers.flatten_map(whole, "runs", "status", "priority")


@query
def training_gate(spark, sf):
    """Two agreeing reviewers and no held family (documented gate)."""
    l = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("region_id"), (F.col("l_orderkey") % 100).alias("family"), F.col("l_linenumber").alias("reviewer"), F.col("l_returnflag").alias("text"))
    held = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("family"))
    return translation.training_ready(l, held)


@query
def timestamp_labels(spark, sf):
    """UTC labels, and which of their forms are dates."""
    e = load(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("label"))
    form = F.when(modulo("event_id", 3) == 0, F.substring("label", 1, 10)).when(modulo("event_id", 3) == 1, F.concat(F.substring("label", 1, 5), F.lit("13-01"))).otherwise(F.replace(F.substring("label", 1, 10), F.lit("-"), F.lit("")))
    good = form.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(form, "yyyy-MM-dd").isNotNull()
    return e.select("event_id", "label", F.coalesce(good, F.lit(False)).alias("is_date"))


@query
def pixel_boxes(spark, sf):
    b = boxes(spark, sf).select("vec_id", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    w = readers.word_boxes(b, 2.5, 2.5)
    return w.select("vec_id", F.col("bbox_pixels")[0].cast("long").alias("px1"), F.col("bbox_pixels")[3].cast("long").alias("py2"))
