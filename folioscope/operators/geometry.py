"""Boxes, table topology and pages of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import bound, strip

# The limits of a table and the share of its box by which a shared edge may differ; the model's coordinate space.
MOST_ROWS, MOST_COLS, EDGE_SHARE, SPACE_SIZE = 200, 100, 0.02, 1000
INDEXES = ("row", "col", "rowspan", "colspan")


def box_valid(box: Column, width, height) -> Column:
    """Four finite numbers with 0 <= x1 < x2 <= width and 0 <= y1 < y2 <= height."""
    finite = (F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    width, height = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    return F.coalesce(finite & (x1 >= 0) & (x1 < x2) & (x2 <= width) & (y1 >= 0) & (y1 < y2) & (y2 <= height), F.lit(False))


def scale_box(box: Column, width, height, space: float = SPACE_SIZE) -> Column:
    """A box of the model's space in pixels; null if it is not valid there."""
    w, h = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    scaled = F.transform(box, lambda v, i: v * F.when(i % 2 == 0, w).otherwise(h) / space)
    return F.when(box_valid(box, space, space), scaled)


def angle_between(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b), 180 - F.abs(a - b))


def union_box(box: str) -> Column:
    """The least box around all boxes of a group."""
    part = lambda i: F.get(F.col(box), F.lit(i))
    return F.array(F.min(part(0)), F.min(part(1)), F.max(part(2)), F.max(part(3)))


def crowded_rows(cells: DataFrame) -> DataFrame:
    """(table_id) of tables in which two cells cover one slot. A cell is one interval of columns in each row it covers."""
    rows = cells.select("table_id", "pos", "col", (F.col("col") + F.col("colspan")).alias("stop"), F.explode(F.expr("sequence(row, row + rowspan - 1)")).alias("r"))
    before = Window.partitionBy("table_id", "r").orderBy("col", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reached", F.max("stop").over(before)).filter("col < reached").select("table_id").distinct()


def inside_grid() -> Column:
    r, c, rs, cs = (F.col(k) for k in INDEXES)
    return F.coalesce((r >= 0) & (c >= 0) & (rs >= 1) & (cs >= 1) & (r + rs <= F.col("rows")) & (c + cs <= F.col("cols")), F.lit(False))


def table_topology(tables: DataFrame, cells: DataFrame, width: float = SPACE_SIZE, height: float = SPACE_SIZE) -> DataFrame:
    """(table_id, topology_valid) for tables (table_id, rows, cols, bbox) and cells (table_id, pos, row, col, rowspan, colspan, bbox).

    Valid: within limits, all cells inside the grid and the table's box, every slot covered once, each boundary there, cells
    that share one agreeing with the cell that named it last within a share of the box, and boundaries strictly rising.
    """
    frame = tables.select("table_id", "rows", "cols", F.col("bbox").alias("frame"))
    frame = frame.withColumn("frame_ok", F.coalesce(F.col("rows").between(1, MOST_ROWS) & F.col("cols").between(1, MOST_COLS), F.lit(False)) & box_valid(F.col("frame"), width, height))
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    held = (at("bbox", 0) >= at("frame", 0)) & (at("bbox", 1) >= at("frame", 1)) & (at("bbox", 2) <= at("frame", 2)) & (at("bbox", 3) <= at("frame", 3))
    placed = cells.join(frame.filter("frame_ok"), "table_id")
    placed = placed.withColumn("good", inside_grid() & box_valid(F.col("bbox"), width, height) & F.coalesce(held, F.lit(False)))
    good = placed.filter("good")
    filled = placed.groupBy("table_id").agg(F.count_if(~F.col("good")).alias("bad"), F.sum(F.when(F.col("good"), F.col("rowspan") * F.col("colspan"))).alias("slots"))
    # each cell names four boundaries, in order
    name = lambda axis, index, v, k: F.struct(F.lit(axis).alias("axis"), index.alias("index"), v.alias("v"), F.lit(k).alias("k"))
    names = F.array(
        name("x", F.col("col") + 0, at("bbox", 0), 0),
        name("x", F.col("col") + F.col("colspan"), at("bbox", 2), 1),
        name("y", F.col("row") + 0, at("bbox", 1), 2),
        name("y", F.col("row") + F.col("rowspan"), at("bbox", 3), 3),
    )
    edges = good.select("table_id", "pos", "frame", F.explode(names).alias("e")).select("table_id", "pos", "frame", "e.*")
    named = Window.partitionBy("table_id", "axis", "index").orderBy("pos", "k")
    extent = F.when(F.col("axis") == "x", at("frame", 2) - at("frame", 0)).otherwise(at("frame", 3) - at("frame", 1))
    drift = F.abs(F.col("v") - F.lag("v").over(named)) > extent * EDGE_SHARE
    edges = edges.withColumn("drift", F.coalesce(drift, F.lit(False)))
    last = edges.groupBy("table_id", "axis", "index").agg(F.max_by("v", F.struct("pos", "k")).alias("v"), F.bool_or("drift").alias("drift"))
    falls = F.lead("v").over(Window.partitionBy("table_id", "axis").orderBy("index")) <= F.col("v")
    lines = last.withColumn("falls", F.coalesce(falls, F.lit(False))).groupBy("table_id").agg(F.count_if(F.col("axis") == "x").alias("xs"), F.count_if(F.col("axis") == "y").alias("ys"), F.bool_or(F.col("drift") | F.col("falls")).alias("broken"))
    crowded = crowded_rows(good).withColumn("crowded", F.lit(True))
    out = frame.join(filled, "table_id", "left").join(lines, "table_id", "left").join(crowded, "table_id", "left")
    valid = F.col("frame_ok") & (F.col("bad") == 0) & (F.col("slots") == F.col("rows") * F.col("cols")) & F.col("crowded").isNull() & (F.col("xs") == F.col("cols") + 1) & (F.col("ys") == F.col("rows") + 1) & ~F.col("broken")
    return out.select("table_id", F.coalesce(valid, F.lit(False)).alias("topology_valid"))


def nested_topology(table: Column, width: float = SPACE_SIZE, height: float = SPACE_SIZE) -> Column:
    """topology_valid, as table_topology finds it, of a struct (rows, cols, bbox, cells) that holds its own cells: within its row, by one sort
    of the boundaries that cells name. Slots and boundaries are listed only when the cells are as large together as the grid, which has limits."""
    rows, cols, frame, cells = (table[k] for k in ("rows", "cols", "bbox", "cells"))
    at = lambda box, i: F.get(box, F.lit(i))
    frame_ok = F.coalesce(rows.between(1, MOST_ROWS) & cols.between(1, MOST_COLS), F.lit(False)) & box_valid(frame, width, height)

    def good(c: Column) -> Column:
        inside = (c["row"] >= 0) & (c["col"] >= 0) & (c["rowspan"] >= 1) & (c["colspan"] >= 1) & (c["row"] <= rows - c["rowspan"]) & (c["col"] <= cols - c["colspan"])
        held = (at(c["bbox"], 0) >= at(frame, 0)) & (at(c["bbox"], 1) >= at(frame, 1)) & (at(c["bbox"], 2) <= at(frame, 2)) & (at(c["bbox"], 3) <= at(frame, 3))
        return F.coalesce(inside, F.lit(False)) & box_valid(c["bbox"], width, height) & F.coalesce(held, F.lit(False))

    def slots(c: Column) -> Column:
        return F.flatten(F.transform(F.sequence(c["row"], c["row"] + c["rowspan"] - 1), lambda r: F.sequence(r * cols + c["col"], r * cols + c["col"] + c["colspan"] - 1)))

    def edges(c: Column, pos: Column) -> Column:
        name = lambda axis, index, v, k: F.struct(F.lit(axis).alias("axis"), index.alias("index"), pos.alias("pos"), F.lit(k).alias("k"), v.alias("v"))
        return F.array(name(0, c["col"] + 0, at(c["bbox"], 0), 0), name(0, c["col"] + c["colspan"], at(c["bbox"], 2), 1), name(1, c["row"] + 0, at(c["bbox"], 1), 2), name(1, c["row"] + c["rowspan"], at(c["bbox"], 3), 3))

    def agree(e: Column) -> Column:
        same = lambda a, b: (a["axis"] == b["axis"]) & (a["index"] == b["index"])
        extent = lambda a: F.when(a["axis"] == 0, at(frame, 2) - at(frame, 0)).otherwise(at(frame, 3) - at(frame, 1))
        drift = F.exists(F.sequence(F.lit(1), F.size(e) - 1), lambda i: same(F.get(e, i), F.get(e, i - 1)) & (F.abs(F.get(e, i)["v"] - F.get(e, i - 1)["v"]) > extent(F.get(e, i)) * EDGE_SHARE))
        last = F.filter(e, lambda x, i: (i == F.size(e) - 1) | ~same(x, F.get(e, i + 1)))
        return ~drift & bound(last, rise)

    def rise(last: Column) -> Column:
        there = (F.size(last) == rows + cols + 2) & (F.size(F.filter(last, lambda x: x["axis"] == 0)) == cols + 1)
        return there & F.forall(F.sequence(F.lit(1), F.size(last) - 1), lambda i: (F.get(last, i)["axis"] != F.get(last, i - 1)["axis"]) | (F.get(last, i)["v"] > F.get(last, i - 1)["v"]))

    area = F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c["rowspan"] * c["colspan"])
    whole = F.size(F.array_distinct(F.flatten(F.transform(cells, slots)))) == rows * cols
    valid = F.when(frame_ok & (F.size(cells) > 0) & F.forall(cells, good), F.when(area == rows * cols, whole & bound(F.sort_array(F.flatten(F.transform(cells, edges))), agree)))
    return F.coalesce(valid, F.lit(False))


# ---------------------------------------------------------------- model output
def unwrap_json(text: Column) -> Column:
    """A strict JSON object, alone or in one presentation fence, as a variant; else null."""

    def inner(plain: Column) -> Column:
        fenced = plain.startswith("```json\n") & plain.endswith("```")
        return F.when(fenced, strip(F.substring(plain, F.lit(9), F.greatest(F.length(plain) - 11, F.lit(0))))).otherwise(plain)

    # what parses and begins so is an object; the schema of the whole page is not needed
    return bound(bound(strip(text), inner), lambda json: F.when(json.startswith("{"), F.try_parse_json(json)))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _number(v: Column) -> Column:
    """A JSON number as a double; true and false count as 1 and 0 in boxes."""
    kind = _kind(v)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))


def _whole(v: Column) -> Column:
    """A JSON whole number; not 1.0 and not true."""
    return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "int"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def _box(v: Column) -> Column:
    return F.transform(_get(v, "bbox", "array<variant>"), _number)


def _region(v: Column) -> Column:
    return F.struct(_text(_get(v, "text")).alias("text"), _box(v).alias("bbox"))


def _cell(v: Column) -> Column:
    return F.struct(*[_whole(_get(v, k)).alias(k) for k in INDEXES], _text(_get(v, "text")).alias("text"), _box(v).alias("bbox"))


def _table(v: Column) -> Column:
    return F.struct(_whole(_get(v, "rows")).alias("rows"), _whole(_get(v, "cols")).alias("cols"), _box(v).alias("bbox"), F.transform(_get(v, "cells", "array<variant>"), _cell).alias("cells"))


class Pages:
    """Parsed pages: pages (page_id, ok, lines, tables, issues), lines, tables with topology_valid, cells; boxes in pixels.

    A page is all or nothing: one malformed region, cell or box makes it not ok, with no lines and tables. A table
    of bad topology only adds an issue.
    """

    def __init__(self, raw: DataFrame, keep=DataFrame.persist):
        """raw: page_id, text, width, height. keep holds the parsed pages, which several results share, so that no text is parsed twice."""
        data = raw.withColumn("v", unwrap_json(F.col("text")))
        data = data.select("page_id", "width", "height", F.transform(_get(F.col("v"), "regions", "array<variant>"), _region).alias("regions"), F.transform(_get(F.col("v"), "tables", "array<variant>"), _table).alias("tables"))
        good_box = lambda b: box_valid(b, SPACE_SIZE, SPACE_SIZE)
        good_item = lambda x: x["text"].isNotNull() & good_box(x["bbox"])
        ok = F.forall("regions", good_item) & F.forall("tables", lambda t: good_box(t["bbox"]) & F.coalesce(F.forall(t["cells"], good_item), F.lit(False)))
        data = data.withColumn("ok", F.coalesce(F.col("regions").isNotNull() & F.col("tables").isNotNull() & ok, F.lit(False)))
        data = data.withColumn("topologies", F.when(F.col("ok"), F.transform("tables", lambda t: nested_topology(t))))
        self.parsed = data = keep(data)
        sound = data.filter("ok")
        place = lambda b: scale_box(b, F.col("width"), F.col("height"))
        self.lines = sound.select("page_id", "width", "height", F.posexplode("regions").alias("pos", "r")).select("page_id", "pos", F.col("r.text").alias("text"), place(F.col("r.bbox")).alias("bbox"))
        tables = sound.select("page_id", "width", "height", "topologies", F.posexplode("tables").alias("pos", "t")).withColumn("table_id", F.struct("page_id", "pos"))
        cells = tables.select("table_id", "width", "height", F.posexplode("t.cells").alias("pos", "c")).select("table_id", "width", "height", "pos", "c.*")
        self.cells = cells.withColumn("bbox", place(F.col("bbox"))).drop("width", "height")
        self.tables = tables.select("table_id", "page_id", "pos", F.col("t.rows").alias("rows"), F.col("t.cols").alias("cols"), place(F.col("t.bbox")).alias("bbox"), F.get("topologies", F.col("pos")).alias("topology_valid"))
        size = lambda c: F.when(F.col("ok"), F.size(c)).otherwise(F.lit(0))
        self.pages = data.select("page_id", "ok", size("regions").alias("lines"), size("tables").alias("tables"), size(F.filter("topologies", lambda v: ~v)).cast("long").alias("issues"))
