import copy
import hashlib
import io
import json
import os
import zipfile

import pytest

from folioscope.operators.metrics import check_rollup
from folioscope.plans import verify
from folioscope.sources import readers, writers

PNG = b"\x89PNG\r\n\x1a\nrest"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(body: str, fonts: int = 0) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for i in range(fonts):
            z.writestr(f"word/fonts/font{i}.odttf", b"f")
    return out.getvalue()


def document(cells=None, translated=None) -> bytes:
    line = {"text": "a", "translated_text": translated}
    block = {"text_lines": [line, {"text": "b"}], "image_overlay_text": [{"text": "o"}]}
    if cells:
        block["table"] = {"rows": 1, "cols": 2, "cells": cells}
    return json.dumps({"errors": [], "pages": [{"blocks": [block]}]}).encode()


CELLS = [{"row": 0, "col": 0, "rowspan": 1, "colspan": 1, "text": "Ø 5"}, {"row": 0, "col": 1, "rowspan": 1, "colspan": 1, "text": "B"}]
SCORE = {"cell_exact": 2, "cell_total": 2, "reference_characters": 4, "character_edits": 0, "cer": 0.0, "matching_cell_spans": 2, "predicted_cells": 2, "merges": {"true_positive": 0, "false_positive": 0, "false_negative": 0}}
TRUTH = {"rows": 1, "cols": 2, "physical_cell_count": 2, "merged_cell_count": 0, "cells": CELLS}
TRUTH_PATH = "artifacts/merged-table-ground-truth.json"


def local_package():
    files, cases = {TRUTH_PATH: json.dumps(TRUTH).encode(), "score.json": json.dumps(SCORE).encode()}, {}
    for name in ("plos", "merged-table"):
        files |= {f"{name}.pdf": b"%PDF-1", f"{name}.png": PNG, f"{name}.json": document(CELLS if name == "merged-table" else None), f"{name}.docx": word("<w:tbl/><w:p/>"), f"{name}.in": b"i"}
        cases[name] = {"input": f"{name}.in", "json": f"{name}.json", "docx": f"{name}.docx", "render_pdf": f"{name}.pdf", "render_pngs": [f"{name}.png"], "text_line_count": 2, "ocr_executed": True, "docx_generated": True, "visual_acceptance": "ok", "observations": ["x"]}
    cases["merged-table"]["table_score"] = "score.json"
    return files, {"schema_version": "local-showcase-evidence-v1", "run_date": "2026-10-26", "environment": {"a": 1}, "models": {"m": 1}, "source": "s", "cases": cases}


def frame(spark, files, record):
    record = copy.deepcopy(record)
    record.setdefault("files", {p: {"bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for p, b in files.items()})
    return spark.createDataFrame([(p, bytearray(b)) for p, b in (files | {"run.json": json.dumps(record).encode()}).items()], "path string, content binary")


def failed(checks):
    return {r["check_id"] for r in checks.filter("not passed").collect()}


def test_local_run(spark):
    files, record = local_package()
    checks = verify.verify_local(frame(spark, files, record), "run.json")
    assert failed(checks) == set()
    total = check_rollup(checks).first()
    assert total["ok"] and total["checks_passed"] == 1 + len(files) + 2 + 2 + 2 + 1 + 4


def test_local_mutations_fail_by_name(spark):
    """Several faults at once, each found by the check that is named for it."""
    files, record = local_package()
    record["files"] = {p: {"bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for p, b in files.items()}
    record["files"]["plos.in"]["bytes"] = 7
    record["files"]["plos.json"]["sha256"] = "0" * 63
    record["cases"]["plos"]["text_line_count"] = 3
    files |= {"plos.docx": b"PK no container", "plos.png": b"no image", "score.json": json.dumps({**SCORE, "cell_exact": 1}).encode()}
    for p in ("plos.docx", "plos.png", "score.json"):
        record["files"][p] = {"bytes": len(files[p]), "sha256": hashlib.sha256(files[p]).hexdigest()}
    assert failed(verify.verify_local(frame(spark, files, record), "run.json")) == {"file_hash:plos.in", "file_hash:plos.json", "text_line_count:plos", "docx_readable:plos", "render_signature:plos:plos.png", "table_score:merged-table"}


@pytest.mark.parametrize(
    "spoil, expected",
    [
        (lambda r: (r["cases"]["plos"].update(text_line_count=True), r["cases"]["merged-table"].update(docx="../x")), {"case_paths:plos", "case_paths:merged-table"}),
        (lambda r: r.update(run_date="20261026"), {"read_local_run"}),
    ],
)
def test_records_that_cannot_be_used(spark, spoil, expected):
    files, record = local_package()
    spoil(record)
    rec = verify.Record(frame(spark, files, record), "run.json", ("local-showcase-evidence-v1",), "read_local_run", ("merged-table", "plos"))
    lines = verify._int(rec.cases["c"], "text_line_count")
    assert failed(rec.read.unionByName(rec.case_checks(("ocr_executed", "docx_generated"), verify.PATHS_LOCAL, ~(lines >= 0))[0])) == expected


def translation_package():
    files, cases = {TRUTH_PATH: json.dumps(TRUTH).encode(), "score.json": json.dumps(SCORE).encode()}, {}
    for name in ("plos", "merged-table"):
        docx = word("<w:p><w:framePr/><w:r><w:t>汉字</w:t></w:r></w:p>", 1)
        review = {"acceptance": "passed_for_page_layout", "overlap_seen": False, "clipping_seen": False, "page_overflow_seen": False, "source_text_ghosts_seen": False, "rendered_pages": 1, "source_pages": 1}
        audit = {"docx_sha256": hashlib.sha256(docx).hexdigest(), "visual_review": review, "layout": {"font_embedding": {"status": "success"}, "failed_region_count": 0, "page_plans": [{"failed_erase_regions": []}]}, "report": {"passed": True, "violations": []}}
        run = {"translation_executed": True, "docx_generated": True, "renderer_confirmed": "FaithfulWordBuilder", "translation_parameters": {"source_lang": "en", "target_lang": "zh", "runtime_options": {"_faithful_layout": True, "_preserve_block_boundaries": True}}}
        log = {"model": "m", "revision": "r", "generation": {"beams": 1}, "requests": [{"request": {"q": "a", "source": "en", "target": "zh"}, "response": {"translatedText": "字"}}, {"request": {"q": ["a", "b"], "source": "en", "target": "zh"}, "response": {"translatedText": ["字", "b"]}}]}
        files |= {f"{name}.pdf": b"%PDF-1", f"{name}.png": PNG, f"{name}.s.json": document(CELLS), f"{name}.t.json": document(CELLS, "字"), f"{name}.docx": docx, f"{name}.in": b"i", f"{name}.audit": json.dumps(audit).encode(), f"{name}.run": json.dumps(run).encode(), f"{name}.log": json.dumps(log).encode()}
        cases[name] = {"input": f"{name}.in", "source_json": f"{name}.s.json", "translated_json": f"{name}.t.json", "docx": f"{name}.docx", "model_responses": f"{name}.log", "execution": f"{name}.run", "render_audit": f"{name}.audit", "render_pdf": f"{name}.pdf", "render_pngs": [f"{name}.png"], "translation_executed": True, "docx_generated": True, "visual_acceptance": "passed_for_page_layout", "observations": []}
    cases["merged-table"]["source_table_score"] = "score.json"
    return files, {"schema_version": "faithful-translation-showcase-evidence-v1", "run_date": "2026-10-27", "environment": {"a": 1}, "models": {"m": 1}, "source": "s", "cases": cases}


def test_translation_run(spark):
    files, record = translation_package()
    assert failed(verify.verify_translation(frame(spark, files, record), "run.json")) == set()


def changed(name, **change):
    def spoil(files, record):
        data = json.loads(files[name])
        for path, value in change.items():
            at = data
            *steps, last = path.split("__")
            for s in steps:
                at = at[s]
            at[last] = value
        files[name] = json.dumps(data).encode()

    return spoil


@pytest.mark.parametrize(
    "spoils, expected",
    [
        (
            [changed("plos.run", renderer_confirmed="other"), changed("merged-table.run", translation_executed=1), changed("plos.log", model=""), lambda f, r: f.update({"plos.t.json": document(CELLS, "latin")})],
            {"faithful_evidence:plos", "execution_record:merged-table", "model_responses:plos", "translated_text:plos"},
        ),
        (
            [changed("plos.audit", report__violations=["v"]), changed("merged-table.audit", visual_review__clipping_seen=None), lambda f, r: f.update({"merged-table.docx": word("<w:p><w:framePr/><w:r><w:t>latin</w:t></w:r></w:p>", 1)})],
            {"faithful_evidence:plos", "faithful_evidence:merged-table", "docx_chinese:merged-table"},
        ),
    ],
)
def test_translation_mutations_fail_by_name(spark, spoils, expected):
    files, record = translation_package()
    for spoil in spoils:
        spoil(files, record)
    assert failed(verify.verify_translation(frame(spark, files, record), "run.json")) == expected


def test_publication_from_a_folder(spark, tmp_path):
    root = tmp_path / "package"
    (root / "docs").mkdir(parents=True)
    (root / "generated").mkdir()
    (root / "docs/a.md").write_text("[b](../b.py) [gone](c.md)")
    (root / "b.py").write_text("x = 1")
    (root / "generated/skip.py").write_text("y")
    listed = {p: {"bytes": (root / p).stat().st_size, "sha256": hashlib.sha256((root / p).read_bytes()).hexdigest()} for p in ("docs/a.md", "b.py")}
    (root / "MANIFEST.json").write_text(json.dumps({"files": listed}))
    files = readers.read_files(spark, str(root))
    assert {r["path"] for r in files.collect()} == {"docs/a.md", "b.py", "MANIFEST.json"}
    report = verify.verify_publication(files, "MANIFEST.json").first()
    assert not report["passed"] and report["reviewed_files"] == 2 and report["errors"] == ["docs/a.md: missing or private relative link: c.md"]


def test_export_and_create_only(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    manifest = spark.createDataFrame([("a", 1, hashlib.sha256(b"1").hexdigest())], "path string, bytes bigint, sha256 string")
    to = str(tmp_path / "out")
    assert check_rollup(writers.export(files, manifest, to)).first()["ok"]
    assert [r["path"] for r in spark.read.parquet(to).collect()] == ["a"]
    with pytest.raises(ValueError):
        writers.export(files, manifest, to)
    with pytest.raises(ValueError):
        writers.export(files, manifest.withColumn("bytes", manifest.bytes + 1), str(tmp_path / "other"))
    with pytest.raises(ValueError):
        writers.write_report(manifest, str(tmp_path / "artifacts/x"), str(tmp_path))
    with pytest.raises(ValueError):
        writers.guard_target(spark, str(tmp_path / "x"), (str(tmp_path),))
    writers.write_report(manifest, str(tmp_path / "generated/x"), str(tmp_path))
    assert os.path.isdir(tmp_path / "generated/x")


def test_scene_scores(spark):
    rows = [("general", "s1", str(i), "pid", i > 0, True, False, 1, 10, 0, 1) for i in range(3)]
    rows = spark.createDataFrame(rows, "scene string, sample_id string, id string, kind string, exact boolean, found boolean, needs_review boolean, edits int, reference_characters int, critical_errors int, critical_characters int")
    cases = spark.createDataFrame([("general", "s1", "pid", 2.5, True, (9.0,), "h")], "scene string, sample_id string, kind string, seconds double, page_needs_review boolean, gpu_memory struct<max_device_used_mib:double>, input_sha256 string")
    source = lambda n, digest: spark.createDataFrame([("s1", "pid", n, digest)], "id string, kind string, selected_regions int, image_sha256 string")
    metrics, times, checks = verify.score_scenes(rows, cases, source(3, "h"))
    assert metrics.first()["cer"] == 0.1 and times.first()["p95_seconds"] == 2.5 and times.first()["exact"] == 2 and failed(checks) == set()
    assert failed(verify.score_scenes(rows, cases, source(4, "h"))[2]) == {"case:general:s1"}


def test_read_json_fails_on_malformed_input(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}')
    assert readers.read_json(spark, str(tmp_path / "a.json"), "a int").first()["a"] == 1
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "b.json"), "a int").collect()
