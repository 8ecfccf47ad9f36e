"""Queries on small tables of their own against plain versions: whole texts and whole tables."""

import hashlib
import re

from pyspark.sql import functions as F

from folioscope import queries
from folioscope.functions import literals, text
from folioscope.operators import layout
from test_text import plain_edit_counts


def write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


TURNS = "conv_id long, turn long, role string, text string"


def test_edits_of_whole_turns(spark, tmp_path):
    same = "the same twenty and more characters, "
    said = [same + "Ø 12.5", same + "∅ 12,5 a", "", same * 4, same * 4 + "±", None, same]
    sf = write(spark, [(1, i, "user", t) for i, t in enumerate(said)], TURNS, tmp_path, "conversations")
    pairs = {i: (a, b) for i, (a, b) in enumerate(zip(said, said[1:])) if b is not None}
    want = {i: (None, None) if a is None else plain_edit_counts(a, b) for i, (a, b) in pairs.items()}
    got = {r["turn"]: (r["edits"], r["critical_errors"]) for r in queries.critical_edits(spark, sf).collect()}
    assert got == want and got[0] == (4, 2) and got[3] == (1, 0)
    assert {r["turn"]: r["edits"] for r in queries.edit_distance(spark, sf).collect()} == {i: w[0] for i, w in want.items()}
    whole = [(a.replace(" ", ""), b.replace(" ", "")) for a, b in pairs.values() if a is not None]
    r = queries.compact_cer(spark, sf).first()
    assert (r["exact"], r["edits"], r["characters"]) == (0, sum(plain_edit_counts(a, b)[0] for a, b in whole), sum(len(a) for a, _ in whole))
    changed = {r["turn"]: r["changed"] for r in queries.critical_change(spark, sf).collect()}
    assert changed == {i: i % 5 == 0 or re.findall(text.CHANGE, a) != re.findall(text.CHANGE, b) for i, (a, b) in pairs.items()} and changed[3]


def test_literals_of_whole_documents(spark, tmp_path):
    token = "__LITERAL_0_0123456789AB__"
    said = {1: "x" * 60 + token, 3: "ab cdefgh ijklmnop " * 9 + "end", 5: "ab cdefgh ijklmnop" + " tail" * 20, 21: "y" * 61, 22: "", 23: None, 40: "z" * 80}
    sf = write(spark, list(said.items()), "doc_id long, text string", tmp_path, "documents")

    def plain(i, t):
        """Request, tokens and error."""
        n = i % 20
        if not n or 10 + n > len(t):
            return None, None, "overlapping or invalid span"
        if re.search(literals.TOKEN, t):
            return None, None, "source collides with placeholder namespace"
        a, b = (f"__LITERAL_{k}_{hashlib.sha256(x.encode()).hexdigest()[:12].upper()}__" for k, x in enumerate((t[3:7], t[10 : 10 + n])))
        return t[:3] + a + t[7:10] + b + t[10 + n :], f"{a},{b}", None

    want = {i: plain(i, t) for i, t in said.items() if t is not None}
    got = {r["doc_id"]: (r["request"], r["tokens"], r["error"]) for r in queries.literal_protect(spark, sf).collect()}
    assert {i: got[i] for i in want} == want and want[1][2].startswith("source collides") and got.keys() == said.keys()
    good = {i for i, w in want.items() if w[2] is None}
    back = {r["doc_id"]: (r["restored"], r["ok"], r["whole"]) for r in queries.literal_restore(spark, sf).collect() if said[r["doc_id"]] is not None}
    assert good == {3, 5, 21} and back == {i: (f"<{said[i]}>", True, True) for i in good}
    failed = {r["doc_id"]: (r["strict"], r["any_order"]) for r in queries.literal_restore_fail(spark, sf).collect() if said[r["doc_id"]] is not None}
    assert failed == {i: (False, i % 4 == 2) for i in good}


def test_outputs_and_logs_of_whole_turns(spark, tmp_path):
    long = "a line of more than forty characters, all of it plain"
    said = {5: long + "\nb", 6: long + " {", 8: long + " {x}", 7: long, 14: long + "\rb", 22: "}{", 24: long + "}"}
    sf = write(spark, [(0, i, "user", t) for i, t in said.items()], TURNS, tmp_path, "conversations")
    got = {r["turn"]: r["verdict"] for r in queries.output_valid(spark, sf).collect()}
    assert got == {5: "multiple_annotation_output", 6: "invalid_formula_structure", 8: "ok", 7: "ok", 14: "ok", 22: "invalid_formula_structure", 24: "invalid_formula_structure"}
    logs = write(spark, [(1, 0, "user", "    late"), (2, 1, "user", "ab  " + "    " + "late"), (3, 1, "user", "abcd")], TURNS, tmp_path / "logs", "conversations")
    assert {r["log_id"]: (r["response_entries"], r["error"] is None) for r in queries.response_log(spark, logs).collect()} == {1: (1, True), 2: (2, True), 3: (0, False)}


def test_geometry_of_all_lines(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    part = {(2, 5): 11, (3, 5): 7, (4, 6): 22}  # edges off by too much, by a little, by too much
    rows = [(t, i, part.get((t, i), 1), 1, 1.0, "A", "F") for t in (1, 2, 3, 4) for i in range(1, 8)] + [(5, i, 1, 1, 1.0, "A", "F") for i in (1, 2, 3, 4, 6)]
    sf = write(spark, rows, line, tmp_path, "lineitem")
    assert {r["table_id"]: r["topology_valid"] for r in queries.table_geometry(spark, sf).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_lines_that_repeat_a_number(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string"
    rows = [(1, i, 2, 2, 1.0, "A", "F") for i in (1, 2, 3)] + [(2, i, 2, 2, 1.0, "A", "F") for i in (1, 2, 2)] + [(3, i, 2, 2, 1.0, "A", "F") for i in (1, 1, 3, 3, 3)]
    sf = write(spark, rows, line, tmp_path, "lineitem")
    assert {r["table_id"]: r["topology_valid"] for r in queries.table_geometry(spark, sf).collect()} == {1: True, 2: False, 3: False}
    # all lines are true and predicted cells; the third predicted one is elsewhere
    assert {r["table_id"]: (r["cell_exact"], r["cell_total"], r["predicted_cells"]) for r in queries.table_score(spark, sf).collect()} == {1: (2, 3, 3), 2: (2, 3, 3), 3: (4, 5, 5)}


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def plain_fit(text, width_pt, height_pt, size, most):
    """The first of lines, size, tracking and scale that fits: (text, size, scale, tracking, lines, width, fits)."""
    width, end = max(4.0, width_pt - 0.5), 0.0
    for lines in range(1, most + 1):
        cut = layout.broken(text, lines, size, 0.52)
        parts = cut.split("\n")
        unit = [layout._width(p, 1.0, 0.52) * 1.04 for p in parts]
        for font in (size, size - 0.25, size - 0.5):
            if len(parts) * font * 1.15 <= height_pt + 0.01:
                for tracking in layout.TRACKING:
                    raw = max(u * font + (len(p) - 1) * tracking for u, p in zip(unit, parts))
                    end = raw * layout.SCALES[-1]
                    for scale in layout.SCALES:
                        if raw * scale <= width + 1.25:
                            return cut, font, scale, tracking, len(parts), raw * scale, True
    return cut, size - 0.5, layout.SCALES[-1], layout.TRACKING[-1], len(parts), end, False


def parts_in_one_file(spark, folder):
    words = ("hot", "small", "ring", "bolt-5", "a", "reinforced")
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 3 + i % 5)), f"Brand#{i % 30}", "LARGE", 1 + i * 7 % 50, 1.0) for i in range(120)]
    spark.createDataFrame(rows, PART).coalesce(1).write.parquet(f"{folder}/part.parquet")
    boxes = {r[0]: (f"{r[1]} {r[2]} {r[3]}", r[4] * 6.0, 10.0 + r[0] % 40, 8.0 + r[0] % 5) for r in rows}
    assert len({min(3, plain_fit(*b, 3)[4]) * plain_fit(*b, 3)[6] for b in boxes.values()}) == 4  # none, one, two, three lines
    return str(folder), boxes


def test_boxes_of_one_file_are_fitted_on_all_cores(spark, tmp_path):
    sf, boxes = parts_in_one_file(spark, tmp_path)
    assert queries.fit_boxes(spark, sf).select(F.spark_partition_id()).distinct().count() == 4
    fit = layout.copy_fit(queries.fit_boxes(spark, sf).withColumn("max_lines", F.lit(3))).collect()
    for r in fit:
        want = plain_fit(*boxes[r["id"]], 3)
        assert (r["text"], r["line_count"], r["fits"]) == (want[0], want[4], want[6])
        assert max(abs(r[c] - w) for c, w in (("font_size", want[1]), ("width_scale", want[2]), ("tracking_pt", want[3]), ("required_width_pt", want[5]))) < 1e-9
    assert len(fit) == len(boxes) == queries.copy_fit_multi(spark, sf).count()


def test_single_lines_of_one_file_are_fitted_on_all_cores(spark, tmp_path):
    sf, boxes = parts_in_one_file(spark, tmp_path)
    fit = queries.copy_fit_single(spark, sf).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in fit}) == 4 and sorted(r["id"] for r in fit) == sorted(boxes)
    for r in fit:
        want = plain_fit(*boxes[r["id"]], 1)
        assert (r["text"], r["line_count"], r["fits"]) == (want[0], want[4], want[6])
        assert max(abs(r[c] - w) for c, w in (("font_size", want[1]), ("width_scale", want[2]), ("tracking_pt", want[3]), ("required_width_pt", want[5]))) < 1e-9
