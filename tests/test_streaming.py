import json

from folioscope.streaming import evidence


def test_stream_appends_each_observation_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda region, text: json.dumps({"report_id": "r", "region_id": region, "text": text, "status": "ok", "ts": "2026-01-01T00:00:00"})
    (source / "1.json").write_text("\n".join([row("a", "5"), row("a", "5"), row("z", "5")]))
    regions = spark.createDataFrame([("r", "a")], "report_id string, region_id string")
    schema = "report_id string, region_id string, text string, status string, ts timestamp"
    read = lambda: spark.readStream.schema(schema).json(str(source))
    for _ in range(2):  # the second run goes on from the checkpoint
        q = evidence.append(evidence.accepted(read(), regions), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        (source / "2.json").write_text(row("a", "6"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("text").collect()
    assert [(r["text"], r["confidence"], r["needs_review"]) for r in got] == [("5", None, True), ("6", None, True)]


def test_rejected_stream(spark, tmp_path):
    obs = spark.createDataFrame([("r", "z")], "report_id string, region_id string")
    assert evidence.rejected(obs, spark.createDataFrame([("r", "a")], "report_id string, region_id string")).first()["reason"] == "unknown_region"
