import json
import random

import pytest

from soripark.operators import calibration
from soripark.sources import stores


def test_artifacts_in_three_shapes_and_a_broken_file(spark, tmp_path):
    seg = {"alignment": {"forced": {"segments": [{"token": "a", "confidence": 0.5}]}}, "gates": {"alignment_confidence_gate": {"performed": True, "passed": True}}}
    for i, status in enumerate([{"status": {"evaluation_status": "ready"}}, {"status": "ready"}, {"evaluation_status": "ready"}, {"status": "retry"}]):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "x.json").write_text(json.dumps(status | seg, indent=1))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text(json.dumps({"status": "ready"}))
    got = calibration.token_confidences(stores.read_artifacts(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == [("a", 0.5)] * 3


def test_calibration_store(spark, tmp_path):
    path = str(tmp_path / "c")
    assert stores.load_calibration(spark, path) is None
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError):
        stores.load_calibration(spark, path)
    stores.write_calibration(spark.createDataFrame([("a", 0.1, 0.02)], "token string, calibrated_low_threshold double, calibrated_very_low_threshold double"), path + "2")
    assert stores.load_calibration(spark, path + "2").count() == 1


def test_cards_keep_file_order(spark, tmp_path):
    (tmp_path / "cards.json").write_text(json.dumps([{"id": "b", "unit": 2, "puzzles": []}, {"id": "a", "type": "t"}]))
    assert [(r.pos, r.id, r.unit) for r in stores.read_cards(spark, str(tmp_path / "cards.json")).orderBy("pos").collect()] == [(0, "b", 2), (1, "a", None)]


def test_distributions_round_trip(spark, tmp_path):
    rows = [("s", 0, "w", [1.0], [2.0], [[3.0]], "diagonal", 4, [[0.5]]), ("s", 1, "v", [1.5], [2.0], [[3.0]], "diagonal", 4, [])]
    df = spark.createDataFrame(rows, "text string, eojeol_idx int, eojeol string, mean array<double>, std array<double>, cov_inv array<array<double>>, mode string, n int, syllable_contours array<array<double>>")
    stores.write_distributions(df, str(tmp_path / "d"))
    assert sorted(map(tuple, stores.read_distributions(spark, str(tmp_path / "d")).collect())) == sorted(rows)


WORDS = "text string, eojeol_idx int, eojeol string, mean array<double>, std array<double>, cov_inv array<array<double>>, mode string, n int, syllable_contours array<array<double>>"


def test_distribution_shards(spark, tmp_path):
    """Every sentence lands in one of the shards, none holds all, and doubles come back to the last bit."""
    rng = random.Random(3)
    rows = [(f"문장 {i}", j, f"말{j}", [rng.gauss(0, 1) for _ in range(12)], [rng.random() for _ in range(12)], [[rng.gauss(0, 1) for _ in range(12)] for _ in range(12)] if i % 2 else None, "full_shrunk" if i % 2 else "diagonal", i, [[rng.random()] * 50]) for i in range(40) for j in range(3)]
    words = spark.createDataFrame(rows, WORDS).repartition(5)
    stores.write_distributions(words, str(tmp_path / "d"), 7)
    maps = [json.loads(line) for f in (tmp_path / "d").glob("*.json") for line in f.read_text().splitlines()]
    assert 4 <= len(maps) <= 7 and sum(len(m["sentences"]) for m in maps) == 40 and max(len(m["sentences"]) for m in maps) < 25
    assert sorted(map(tuple, stores.read_distributions(spark, str(tmp_path / "d")).collect())) == sorted(rows)
    one = {"sentences": {t: e for m in maps for t, e in m["sentences"].items()}}
    (tmp_path / "whole.json").write_text(json.dumps(one, indent=2, ensure_ascii=False))
    assert sorted(map(tuple, stores.read_distributions(spark, str(tmp_path / "whole.json"), lines=False).collect())) == sorted(rows)
    stores.write_distributions(words.limit(0), str(tmp_path / "none"))
    assert stores.read_distributions(spark, str(tmp_path / "none")).count() == 0


def test_artifact_store_by_day(spark, tmp_path):
    path = str(tmp_path / "a")
    segments = lambda *tokens: [(x, x, 0.0, 1.0, 0, 1, 0.5) for x in tokens]
    rows = [("2024-01-01", "ready", segments("a", "b")), ("2024-01-01", "retry", segments("c")), ("2024-01-02", "ready", segments("d")), ("2024-01-03", "ready", [])]
    df = spark.createDataFrame(rows, "day string, s string, g array<struct<token: string, label: string, start_time: double, end_time: double, frame_start: int, frame_end: int, confidence: double>>")
    nested = df.selectExpr("day", "named_struct('evaluation_status', s) as status", "named_struct('alignment_confidence_gate', named_struct('performed', true, 'passed', true)) as gates", "named_struct('forced', named_struct('segments', g)) as alignment")
    stores.write_artifacts(nested, path, "day")
    with pytest.raises(Exception):
        stores.write_artifacts(nested, path, "day")
    for day, text in (("2024-01-02", '{"status": {"evaluation_st\n[1, 2]\n\n{"status": "ready"}\n'), ("2024-01-03", "nonsense")):
        (tmp_path / "a" / f"day={day}" / "more.json").write_text(text)
    scanned = stores.scan_artifacts(spark, path)
    got = list((str(r.day), r.status.evaluation_status, r.broken is not None, len(r.alignment.forced.segments) if r.alignment else None) for r in scanned.where("broken is null").collect())
    assert sorted(got, key=repr) == [("2024-01-01", "ready", False, 2), ("2024-01-01", "retry", False, 1), ("2024-01-02", "ready", False, 1), ("2024-01-02", "ready", False, None), ("2024-01-03", "ready", False, 0)]
    counts = {r.file.rsplit("/", 2)[-2]: r.n_broken for r in stores.quarantine(scanned, str(tmp_path / "q")).collect()}
    assert counts == {"day=2024-01-02": 2, "day=2024-01-03": 1}
    one = stores.scan_artifacts(spark, path).where("day = '2024-01-01'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and one.count() == 2
    # one day anew: its faults are gone, the others stay
    stores.write_artifacts(nested.where("day = '2024-01-02'"), path, "day", replace=True)
    again = stores.scan_artifacts(spark, path)
    assert again.where("broken is not null").count() == 1 and again.where("day = '2024-01-02'").count() == 1 and again.where("day = '2024-01-01'").count() == 2
    assert calibration.token_confidences(again.where("broken is null")).count() == 3
