import json
import random

from pyspark.sql import functions as F

from folioscope.operators import evidence, geometry, integrity, metrics, policy, routing, tables, tolerance, translation
from folioscope.sources import readers


def decision(mode, reason, pages, texts):
    return F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"), F.lit(pages).alias("page_count"), F.lit(texts).alias("text_pages"))


def test_scan_risk(one):
    waits = [one(routing.scan_risk(decision("ocr", "low_text_density", n, 0)))["sync_recommended"] for n in (5, 6, 20)]
    assert waits == [True, False, False]
    assert one(routing.scan_risk(decision("direct", "text_pdf", 100, 0)))["estimated_ocr_pages"] == 0
    assert one(routing.scan_risk(decision("ocr", "x", 20, 0)))["warnings"] == ["scan_pdf_long_task", "scan_pdf_very_long_task", "sync_not_recommended"]


def test_routing_guards(spark):
    rows = [("a.txt", "auto", "docx", 1, 1, 99), ("a.PDF", "auto", "pptx", 4, 1, 9), ("a.pdf", " Native", "docx", 1, 0, 0), ("a.pdf", "ocr-word", "docx", 1, 0, 0), ("a.pdf", None, "docx", None, None, None), ("a.pdf", "?", "docx", 0, 0, 0), ("a.pdf", "auto", "docx", 5, 3, 200), ("a.pdf", "auto", "docx", 5, 2, 900), (".pdf", "auto", "docx", 1, 1, 99)]
    df = spark.createDataFrame(rows, "path string, r string, f string, page_count int, text_pages int, total_text_chars int")
    got = [r["d"] for r in df.select(routing.decide(F.col("path"), F.col("r"), F.col("f")).alias("d")).collect()]
    assert [g["reason"] for g in got] == ["not_pdf", "not_docx", "forced_direct", "forced_ocr", "preflight_failed", "empty_pdf", "text_pdf", "low_text_density", "not_pdf"]
    assert got[1]["page_count"] == 4 and got[3]["page_count"] == 0 and got[6]["mode"] == "direct"


def test_metrics_of_nothing_are_null(spark):
    rows = spark.createDataFrame([("a", True, True, False, 0, 0, 0, 0), ("a", False, False, True, 0, 0, 0, 0)], "k string, exact boolean, found boolean, needs_review boolean, edits int, reference_characters int, critical_errors int, critical_characters int")
    (r,) = metrics.aggregate_regions(rows, "k").collect()
    assert r["cer"] is None and r["critical_character_accuracy"] is None and r["annotation_accuracy"] == 0.5 and r["miss_rate"] == 0.5
    (m,) = rows.groupBy("k").agg(*metrics.micro_error_rate()).collect()
    assert m["cer"] == 0


def test_percentile_definitions(spark):
    df = spark.createDataFrame([("a", float(i), False, True) for i in range(1, 21)] + [("a", 99.0, True, True), ("b", 1.0, False, False)], "k string, seconds double, warmup boolean, success boolean")
    a, b = metrics.request_summary(df, "k").orderBy("k").collect()
    assert (a["p50_seconds"], a["p95_seconds"], a["max_seconds"]) == (10.5, 19.05, 20.0) and b["p50_seconds"] is None and b["failed"] == 1
    (t,) = df.filter("k = 'a' and not warmup").groupBy("k").agg(*metrics.timing("seconds")).collect()
    assert t["p50_seconds"] == 10.5 and t["p95_seconds"] == 19.0


def test_no_checks_are_ok(spark):
    assert metrics.check_rollup(spark.createDataFrame([], "passed boolean")).first()["ok"]


CELL = "table_id int, pos int, row int, col int, rowspan int, colspan int, text string"


def test_table_validation(spark):
    heads = spark.createDataFrame([(i, 1, 2, 2, 0) for i in range(6)] + [(6, 0, 2, 1, 0)], "table_id int, rows int, cols int, physical_cell_count int, merged_cell_count int")
    good = [(0, 0, 0, 0, 1, 1, "a"), (0, 1, 0, 1, 1, 1, "b")]
    bad = [(1, 0, 0, 0, 1, 3, "a"), (2, 0, 0, 0, 1, 1, "a"), (2, 1, 0, 0, 1, 1, "b"), (3, 0, 0, 0, 1, 2, "a"), (3, 1, 0, 1, 1, 1, "b"), (4, 0, 0, None, 1, 1, "a"), (6, 0, 0, 0, 1, 1, "x")]
    got = {r["table_id"]: r["error"] for r in tables.validate_cells(heads, spark.createDataFrame(good + bad, CELL), True).collect()}
    assert got == {0: None, 1: "cell span outside table", 2: "duplicate cell anchor", 3: "overlapping cell spans", 4: "integer cell positions/spans required", 5: "nonempty cells required", 6: "positive integer row/column counts required"}


def test_table_score_mutations(spark):
    truth = [(0, i, i // 2, i % 2, 1, 1, f"t {i}") for i in range(4)]
    near = [(*r[:6], r[6] + ("!" if r[1] == 0 else "")) for r in truth]
    make = lambda rows: spark.createDataFrame(rows, CELL)
    full = tables.score_tables(make(truth), make(near)).first()
    assert (full["cell_exact"], full["character_edits"], full["matching_cell_spans"]) == (3, 1, 4)
    less = tables.score_tables(make(truth), make(truth[:3])).first()
    assert (less["predicted_cells"], less["matching_cell_spans"], less["cell_exact"]) == (3, 3, 3)


def test_topology(spark):
    heads = spark.createDataFrame([(i, 1, 2, [0.0, 0.0, 100.0, 100.0]) for i in range(3)], "table_id int, rows int, cols int, bbox array<double>")
    cell = "table_id int, pos int, row int, col int, rowspan int, colspan int, bbox array<double>"
    rows = [(0, 0, 0, 0, 1, 1, [0.0, 0.0, 50.0, 100.0]), (0, 1, 0, 1, 1, 1, [51.0, 0.0, 100.0, 100.0]), (1, 0, 0, 0, 1, 1, [0.0, 0.0, 20.0, 100.0]), (1, 1, 0, 1, 1, 1, [50.0, 0.0, 100.0, 100.0]), (2, 0, 0, 0, 1, 1, [0.0, 0.0, 50.0, 100.0])]
    got = {r[0]: r[1] for r in geometry.table_topology(heads, spark.createDataFrame(rows, cell), 100, 100).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_pages(spark):
    page = lambda box, tables: json.dumps({"regions": [{"text": "Ø 5", "bbox": box}], "tables": tables})
    texts = [page([100, 100, 300, 200], []), page([100, 100, 1200, 200], []), page([1, 1, 2, 2], None), "```json\n" + page([0, 0, 1, 1], []) + "```", "x" + page([0, 0, 1, 1], []), '{"regions":[{"text":5,"bbox":[0,0,1,1]}],"tables":[]}', "[]", None]
    raw = spark.createDataFrame([(i, t, 2000, 1000) for i, t in enumerate(texts)], "page_id int, text string, width int, height int")
    p = geometry.Pages(raw)
    assert [r["ok"] for r in p.pages.orderBy("page_id").collect()] == [True, False, False, True, False, False, False, False]
    line = p.lines.filter("page_id = 0").first()
    assert line["text"] == "Ø 5" and line["bbox"] == [200.0, 100.0, 600.0, 200.0]


def test_pages_judge_their_own_tables(spark):
    """A page's tables as table_topology finds them from rows of cells; a page that comes twice has its own issues each time."""
    rng = random.Random(3)

    def table():
        rows, cols, cells = rng.randint(1, 3), rng.randint(1, 3), []
        for r in range(rows):
            c = 0
            while c < cols:
                span = rng.randint(1, cols - c)
                near = lambda v: min(900, max(0, v + rng.choice((0,) * 12 + (3, 40))))  # noqa: B023, E731
                cells.append({"row": r, "col": c, "rowspan": 1 + (rng.random() < 0.05), "colspan": span, "bbox": [near(300 * c), near(300 * r), near(300 * (c + span)), near(300 * (r + 1))], "text": "x"})
                c += span
        if rng.random() < 0.2:
            cells.append(dict(rng.choice(cells), text="again"))
        if rng.random() < 0.1:
            cells.pop()
        return {"bbox": [0, 0, 900, 900], "rows": rows, "cols": cols, "cells": rng.sample(cells, len(cells)) if rng.random() < 0.5 else cells}

    texts = [json.dumps({"regions": [], "tables": [table() for _ in range(rng.randint(0, 3))]}) for _ in range(150)]
    p = geometry.Pages(spark.createDataFrame([(i, t, 2000, 1000) for i, t in enumerate(texts)], "page_id int, text string, width int, height int"))
    t = p.parsed.filter("ok").select("page_id", F.posexplode("tables").alias("pos", "t")).select(F.struct("page_id", "pos").alias("table_id"), "t.*")
    want = {tuple(r[0]): r[1] for r in geometry.table_topology(t, t.select("table_id", F.posexplode("cells").alias("pos", "c")).select("table_id", "pos", "c.*")).collect()}
    got = {tuple(r["table_id"]): r["topology_valid"] for r in p.tables.collect()}
    assert got == want and 20 < sum(got.values()) < len(got) - 20
    bad = next(t for i, t in enumerate(texts) if not all(v for k, v in got.items() if k[0] == i))
    twice = geometry.Pages(spark.createDataFrame([(1, bad, 2000, 1000), (1, bad, 2000, 1000), (1, "[]", 2000, 1000)], "page_id int, text string, width int, height int"), keep=lambda d: d).pages.collect()
    issues = sum(not v for k, v in got.items() if k[0] == texts.index(bad))
    assert sorted((r["ok"], r["issues"]) for r in twice) == [(False, 0), (True, issues), (True, issues)]


def test_policy(one):
    risk = lambda *names: one(policy.risk_priority(F.array(*map(F.lit, names)).cast("array<string>")))
    assert risk("needs_review") is None and risk("positioned_candidate_conflict") < risk("dimension_symbol_completeness_unverified")
    assert risk("low_confidence") is None and risk("low_confidence", "critical_engineering_annotation") == 1
    lit = lambda v, t="string": F.lit(v).cast(t)
    said = lambda text, status="ok", cut=False, task="text": one(policy.output_status(lit(status), lit(text), lit(cut, "boolean"), lit(None), lit(task)))
    assert said("5", "timeout") == "timeout" and said("", cut=True) == "truncated" and said(" ") == "empty_output" and said("a\nb") == "multiple_annotation_output"
    assert said("}{", task="formula") == "invalid_formula_structure" and said(r"\{ {x}", task="formula") == "ok" and said("识别结果：5") == "nonliteral_output" and said(None, None) == "invalid_response"
    change = lambda a, b, task="text": one(policy.critical_change(lit(a), lit(b), lit(task)))
    assert change("10", "Ø10") and change("1.2", "12") and change("+1", "-1") and change("∅2", "Ø2") and not change("NOTE", "NOTES") and change("a", "a", "formula")


def test_tolerance(spark):
    f = "drawing_id int, pos int, id string, texts array<string>, bbox array<double>, angle double"
    three = [(0, "n", ["1.046"], [100.0, 100.0, 200.0, 150.0], 0.0), (1, "u", ["+.003", "+.008"], [205.0, 93.0, 255.0, 115.0], 0.0), (2, "l", [".002"], [206.0, 127.0, 256.0, 150.0], 0.0)]
    rows = [(d, p, i, t, b, 90.0 if d == 1 and i == "u" else a) for d in range(3) for p, i, t, b, a in three]
    cells = spark.createDataFrame([(2, 0, [90.0, 80.0, 202.0, 160.0]), (2, 1, [203.0, 80.0, 300.0, 160.0])], "drawing_id int, idx int, bbox array<double>")
    (g,) = tolerance.annotation_groups(spark.createDataFrame(rows, f), cells).collect()
    assert g["drawing_id"] == 0 and g["candidate_text"] == "1.046 +.003 .002" and g["observed_candidates"] == ["1.046 +.003 .002", "1.046 +.008 .002"]
    assert g["bbox"] == [100.0, 93.0, 256.0, 150.0] and g["needs_review"]


def test_tolerances_are_taken_in_order_from_one_reading(spark):
    """Crowded drawings against a plain version; the fragments are computed once."""
    rng = random.Random(8)
    rows = []
    for d in range(60):
        for k in range(rng.randint(1, 4)):
            y = 100.0 + rng.choice((12, 45, 90)) * k
            rows.append((d, len(rows), f"n{len(rows)}", [f"{k}.5"], [100.0, y, 200.0, y + 50], 0.0))
            for t, up in (("+.003", True), (".002", False)):
                if rng.random() < 0.7:
                    top = y - 7 if up else y + 27
                    rows.append((d, len(rows), f"o{rng.randint(0, 9)}" if rng.random() < 0.1 else f"o{len(rows)}", [t], [205.0 + rng.randint(0, 3), top, 255.0, top + 22], 0.0))
    schema = "drawing_id int, pos int, id string, texts array<string>, bbox array<double>, angle double"
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    fragments = spark.createDataFrame(rows, schema).repartition(3).mapInArrow(counted, schema)
    cells = spark.createDataFrame([], "drawing_id int, idx int, bbox array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # drawings go on from batch to batch
    try:
        got = {(r["drawing_id"], r["id"]): [p["region_id"] for p in r["parts"]] for r in tolerance.annotation_groups(fragments, cells).collect()}
        assert read.value == len(rows)
        pairs = tolerance.neighbour_pairs(fragments, cells).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at, beside, want = {(r[0], r[1]): r for r in rows}, {}, {}
    for r in pairs:
        beside.setdefault((r["drawing_id"], r["nominal"]), []).append(r["neighbour"])
    for d in range(60):
        taken, number = set(), 0
        for pos in sorted(p for e, p in beside if e == d):
            n, left = at[d, pos], [at[d, o] for o in sorted(beside[d, pos]) if at[d, o][2] not in taken]
            if n[2] in taken or len(left) != 2:
                continue
            middle = lambda b: (b[1] + b[3]) / 2
            u, lo = sorted(left, key=lambda r: (r[4][1], r[1]))
            h = n[4][3] - n[4][1]
            if middle(n[4]) - middle(u[4]) > 0.1 * h and middle(lo[4]) - middle(n[4]) > 0.1 * h and u[4][3] - lo[4][1] <= 0.45 * h and "+" in u[3][0] + lo[3][0]:
                want[d, f"engineering-annotation:{number}"] = [n[2], u[2], lo[2]]
                taken.update(want[d, f"engineering-annotation:{number}"])
                number += 1
    assert got == want and len(want) > 10 and any(k[1].endswith(":1") for k in want)


def test_box_matching_is_one_to_one(spark):
    box = "page_id int, kind string, id string, bbox array<double>"
    t = spark.createDataFrame([(0, "line", "a", [0.0, 0.0, 10.0, 10.0]), (0, "line", "b", [1.0, 0.0, 11.0, 10.0])], box)
    p = spark.createDataFrame([(0, "line", "x", [1.0, 0.0, 11.0, 10.0]), (0, "cell", "y", [0.0, 0.0, 10.0, 10.0])], box)
    assert [(r["truth_id"], r["predicted_id"]) for r in tolerance.match_boxes(t, p).collect()] == [("b", "x")]


def test_box_matching_passes_over_sorted_pairs(spark):
    """Pages one after the other in one pass, without a call for each, against a plain version."""
    rng = random.Random(2)
    make = lambda p: [(page, rng.choice(("line", "cell")), f"{p}{i}", [float(x), float(y), x + 20.0, y + 20.0]) for page in range(40) for i in range(rng.randint(0, 8)) for x, y in [(rng.randint(0, 12), rng.randint(0, 12))]]
    truth, predicted = make("t"), make("p")
    box = "page_id int, kind string, id string, bbox array<double>"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        matched = tolerance.match_boxes(spark.createDataFrame(truth, box), spark.createDataFrame(predicted, box))
        got = {(r["page_id"], r["kind"], r["truth_id"], r["predicted_id"]) for r in matched.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def iou(a, b):
        w, h = (min(a[i + 2], b[i + 2]) - max(a[i], b[i]) for i in (0, 1))
        return w * h / (800 - w * h) if w > 0 and h > 0 else 0

    want, used = set(), set()
    for _, page, kind, t, p in sorted((-iou(a[3], b[3]), a[0], a[1], a[2], b[2]) for a in truth for b in predicted if a[:2] == b[:2] and iou(a[3], b[3]) >= 0.2):
        if not {(page, kind, t), (page, kind, p)} & used:
            want.add((page, kind, t, p))
            used |= {(page, kind, t), (page, kind, p)}
    assert got == want and len(got) > 40
    assert "MapInArrow" in matched._jdf.queryExecution().executedPlan().toString()


def evidence_input(spark):
    regions = spark.createDataFrame([("r", "a", False, "open"), ("r", "b", False, "open")], "report_id string, region_id string, needs_review boolean, resolution string")
    had = spark.createDataFrame([], "report_id string, region_id string, pos int, text string, status string, reason string, source string, confidence double")
    seen = spark.createDataFrame([("r", 0, "a", "Ø5", "ok", None), ("r", 1, "a", "Ø5", "ok", None), ("r", 2, "z", "1", "ok", None), ("r", 3, "a", "", "timeout", None)], "report_id string, pos int, region_id string, text string, status string, reason string")
    return regions, had, seen


def test_evidence_is_appended_once(spark):
    regions, candidates, rejected = evidence.attach(*evidence_input(spark))
    state = {r["region_id"]: (r["needs_review"], r["resolution"]) for r in regions.collect()}
    assert state == {"a": (True, evidence.RESOLUTION), "b": (False, "open")}
    assert [(r["text"], r["status"], r["confidence"]) for r in candidates.orderBy("pos").collect()] == [("Ø5", "ok", None), ("", "timeout", None)]
    assert [r["region_id"] for r in rejected.collect()] == ["z"]


def test_compose(spark):
    parts = spark.createDataFrame([("g", i, "p", str(i), [t]) for i, t in enumerate(("1.046", "+.003", "+.002"))], "group_id string, part int, role string, region_id string, observed array<string>")
    cand = lambda status: spark.createDataFrame([("2", 0, "-.002", status, None), ("2", 1, "1 2", "ok", None)], "region_id string, pos int, text string, status string, reason string")
    good = evidence.compose(parts, cand("ok")).first()
    assert good["reviewed_candidates"] == ["1.046 +.003 -.002", "1.046 +.003 +.002"] and good["unreviewed_part_ids"] == ["0", "1"] and good["review_status"] == "partial"
    assert evidence.compose(parts, cand("output_truncated")).first()["reviewed_candidates"] == ["1.046 +.003 +.002"]
    assert evidence.compose(parts, cand("ok"), -1).first()["reviewed_candidates"] == []


def test_files_and_links(spark):
    files = spark.createDataFrame([("a.md", b"[x](b.txt) [y](no.md) [z](ftp://q) [t](#h)"), ("b.txt", b"hello"), ("c.py", b"\xff"), ("api/x.py", b"1")], "path string, content binary")
    known = integrity.identities(files)
    listed = known.filter("path <> 'b.txt'").withColumn("bytes", F.when(F.col("path") == "c.py", 7).otherwise(F.col("bytes"))).unionByName(spark.createDataFrame([("../e", 1, "0" * 64), ("gone", 1, "0" * 64)], "path string, bytes bigint, sha256 string"))
    errors = {(r["path"], r["error"]) for r in integrity.publication_errors(files, listed).collect()}
    assert errors == {("../e", "invalid public relative path"), ("gone", "missing"), ("c.py", "bytes/hash differ from the reviewed file"), ("c.py", "expected UTF-8 text"), ("api/x.py", "outside selected-code publication scope")}
    assert [r["path"] for r in integrity.unlisted(known, listed).collect()] == ["b.txt"]
    links = integrity.link_errors(files.filter("path = 'a.md'").select("path", F.col("content").cast("string").alias("text")), files.select("path"))
    assert {r["target"] for r in links.collect()} == {"no.md", "ftp://q"}


def test_line_count_and_coverage(spark):
    line = {"text": "a", "translated_text": "字"}
    doc = json.dumps({"errors": [], "pages": [{"blocks": [{"text_lines": [line, {"text": "b", "translated_text": " "}], "image_overlay_text": [line], "table": {"cells": [{"text": "字", "raw": {"translated_text": "x"}}]}}]}]})
    df = spark.createDataFrame([(1, doc)], "doc_id int, t string").select("doc_id", F.from_json("t", translation.DOCUMENT).alias("d")).select("doc_id", "d.pages")
    assert df.select(translation.text_line_count(F.col("pages"))).first()[0] == 2
    r = translation.translation_coverage(df).first()
    assert (r["page_count"], r["nonempty_translated_entries"], r["translated_entries_with_script"], r["current_cells_with_script"]) == (1, 3, 2, 1)


def test_bundles(spark):
    b = spark.createDataFrame([("s", "diagnostics", "g", "k", "v", ["c", "d"], [["a", "true", "true", "1", "9", "0", "1", "false"]])], "stage string, suite string, scene string, kind string, view string, categories array<string>, rows array<array<string>>")
    rows = readers.route_bundles(readers.decode_bundles(b, F.array(*map(F.lit, readers.REGION_FIELDS)))).collect()
    assert {r["group"] for r in rows} == {"diagnostics/c/v", "diagnostics/d/v"} and rows[0]["edits"] == 1 and rows[0]["exact"] is True
