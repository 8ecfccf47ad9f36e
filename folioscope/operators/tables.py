"""Recognised tables against their truth, cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import edit_distance, normalize
from folioscope.operators.geometry import INDEXES, crowded_rows, inside_grid


def validate_cells(tables: DataFrame, cells: DataFrame, reference: bool = False) -> DataFrame:
    """(table_id, error): null, or the first rule broken. tables: table_id, rows, cols (and physical_cell_count,
    merged_cell_count of a reference, which must cover its grid); cells: table_id, pos, row, col, rowspan, colspan, text."""
    known = cells.join(tables.select("table_id", "rows", "cols"), "table_id")
    known = known.withColumn("whole", F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("rowspan").isNotNull() & F.col("colspan").isNotNull()).withColumn("inside", inside_grid())
    merged = (F.col("rowspan") > 1) | (F.col("colspan") > 1)
    totals = known.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("whole")).alias("ragged"),
        F.count_if(F.col("whole") & ~F.col("inside")).alias("outside"),
        F.count_if(F.col("text").isNull()).alias("wordless"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct("row", "col"))).alias("twins"),
        F.count_if(merged).alias("merged"),
        F.sum(F.when(F.col("inside"), F.col("rowspan") * F.col("colspan"))).alias("slots"),
    )
    crowded = crowded_rows(known.filter("inside")).withColumn("crowded", F.lit(True))
    both = tables.join(totals, "table_id", "left").join(crowded, "table_id", "left")
    positive = F.coalesce((F.col("rows") > 0) & (F.col("cols") > 0), F.lit(False))
    error = (
        F.when(~positive, "positive integer row/column counts required")
        .when(F.col("n").isNull(), "nonempty cells required")
        .when(F.col("ragged") > 0, "integer cell positions/spans required")
        .when(F.col("outside") > 0, "cell span outside table")
        .when(F.col("twins") > 0, "duplicate cell anchor")
        .when(F.col("crowded"), "overlapping cell spans")
        .when(F.col("wordless") > 0, "cell text must be a string")
    )
    if reference:
        error = (
            error.when(~F.col("physical_cell_count").eqNullSafe(F.col("n")), "physical_cell_count does not match cells")
            .when(~F.col("merged_cell_count").eqNullSafe(F.col("merged")), "merged_cell_count does not match cells")
            .when(F.col("slots") != F.col("rows") * F.col("cols"), "incomplete table grid")
        )
    return both.select("table_id", error.alias("error"))


def compare_cells(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row a true cell: expected and predicted text, edits, and whether its span agrees. A missing cell is empty text."""
    t = truth.select("table_id", *INDEXES, normalize("text").alias("expected"))
    p = predicted.select("table_id", "row", "col", F.col("rowspan").alias("p_rowspan"), F.col("colspan").alias("p_colspan"), normalize("text").alias("p_text"))
    both = t.join(p, ["table_id", "row", "col"], "left").withColumn("predicted", F.coalesce("p_text", F.lit("")))
    same = F.col("rowspan").eqNullSafe(F.col("p_rowspan")) & F.col("colspan").eqNullSafe(F.col("p_colspan"))
    return both.select("table_id", *INDEXES, "expected", "predicted", edit_distance("expected", "predicted").alias("edits"), same.alias("span_matches"))


def compare_merges(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(table_id, true_positive, false_positive, false_negative) of merged cells by position and span."""
    merged = (F.col("rowspan") > 1) | (F.col("colspan") > 1)
    keys = ["table_id", *INDEXES]
    t = truth.filter(merged).select(*keys).distinct().withColumn("t", F.lit(True))
    p = predicted.filter(merged).select(*keys).distinct().withColumn("p", F.lit(True))
    both = t.join(p, keys, "full_outer")
    return both.groupBy("table_id").agg(F.count_if(F.col("t") & F.col("p")).alias("true_positive"), F.count_if(F.col("t").isNull()).alias("false_positive"), F.count_if(F.col("p").isNull()).alias("false_negative"))


def score_tables(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row a true table: exact cells, edits and error rate, matching spans, predicted cells and merges."""
    cells = compare_cells(truth, predicted).groupBy("table_id").agg(
        F.count_if(F.col("expected") == F.col("predicted")).alias("cell_exact"),
        F.count(F.lit(1)).alias("cell_total"),
        F.sum(F.length("expected")).cast("long").alias("reference_characters"),
        F.sum("edits").cast("long").alias("character_edits"),
        F.count_if("span_matches").alias("matching_cell_spans"),
    )
    counts = predicted.groupBy("table_id").agg(F.count(F.lit(1)).alias("predicted_cells"))
    out = cells.join(counts, "table_id", "left").join(compare_merges(truth, predicted), "table_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rate = F.try_divide(F.col("character_edits").cast("double"), F.col("reference_characters").cast("double")).alias("cer")
    return out.select("table_id", "cell_exact", "cell_total", "reference_characters", "character_edits", rate, "matching_cell_spans", *map(zero, ("predicted_cells", "true_positive", "false_positive", "false_negative")))


def score_responses(truth_tables: DataFrame, truth: DataFrame, responses: DataFrame) -> DataFrame:
    """Scores of whole responses (table_id, success, tables array<struct<rows,cols,cells>>), with error where one can't be scored."""
    one = responses.select("table_id", F.when(~F.coalesce("success", F.lit(False)), "response is not successful").when(F.size("tables") != 1, "expected exactly one table").alias("refused"), F.get("tables", F.lit(0)).alias("t"))
    predicted_tables = one.filter("refused is null").select("table_id", "t.rows", "t.cols")
    predicted = one.filter("refused is null").select("table_id", F.posexplode("t.cells").alias("pos", "c")).select("table_id", "pos", "c.*")
    wrong = validate_cells(predicted_tables, predicted).withColumnRenamed("error", "predicted_error")
    bad = validate_cells(truth_tables, truth, True).withColumnRenamed("error", "reference_error")
    sizes = truth_tables.select("table_id", F.col("rows").alias("true_rows"), F.col("cols").alias("true_cols"))
    judged = one.join(sizes, "table_id", "left").join(bad, "table_id", "left").join(wrong, "table_id", "left")
    differs = ~(F.col("t.rows").eqNullSafe(F.col("true_rows")) & F.col("t.cols").eqNullSafe(F.col("true_cols")))
    error = F.coalesce("refused", F.concat(F.lit("reference: "), "reference_error"), F.concat(F.lit("prediction: "), "predicted_error"), F.when(differs, "predicted row/column counts differ from the reference"))
    judged = judged.select("table_id", error.alias("error"))
    scores = score_tables(truth, predicted).join(judged.filter("error is null").select("table_id"), "table_id", "left_semi")
    return judged.join(scores, "table_id", "left")
