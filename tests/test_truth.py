"""Files of true appearances, the scores of stored entities against them, and lists of clusters."""

import json

from sighthound.__main__ import main, parser, run
from sighthound.operators.evaluation import evaluation, overall, reid_counts
from sighthound.operators.stateful import led_clusters, spatial_leaders
from sighthound.sources.store import Store
from sighthound.sources.truth import read_truth, template, truth_cameras

GT = "entity_type string, gt_id string, camera string, f0 long, f1 long"
SYSTEM = "entity_type string, camera string, sys_id long, f0 long, f1 long"
MEMBERS = "entity_type string, identity long, camera string, sys_id long"


def test_template(spark, tmp_path):
    main(["create-template", "--cameras", "gate", "yard", "--output", str(tmp_path / "x" / "gt.json")])
    path = str(tmp_path / "x" / "gt.json")
    assert json.loads((tmp_path / "x" / "gt.json").read_text())["metadata"]["cameras"] == ["gate", "yard"]
    assert truth_cameras(spark, path) == ["gate", "yard"]
    assert [tuple(r) for r in read_truth(spark, path).collect()] == [("person", "P1", "gate", 0, 100)]
    (tmp_path / "none.json").write_text(json.dumps({"persons": {"P1": {"description": "x"}}}))
    assert read_truth(spark, str(tmp_path / "none.json")).count() == 0 and truth_cameras(spark, str(tmp_path / "none.json")) == []
    assert json.loads(template([]))["persons"]["P1"]["appearances"][0]["camera"] == "camera1"


def test_scores(spark):
    gt = [("person", "P1", "a", 0, 100), ("person", "P1", "b", 200, 300), ("person", "P2", "a", 500, 600), ("person", "P2", "b", 700, 800), ("vehicle", "V1", "a", 0, 50)]
    system = [("person", "a", 1, 0, 90), ("person", "b", 2, 210, 300), ("person", "a", 3, 500, 610), ("person", "b", 9, 5000, 5100)]
    members = [("person", 1, "a", 1), ("person", 1, "b", 2), ("person", 3, "a", 3), ("person", 9, "b", 9)]
    rows = {r["entity_type"]: r for r in evaluation(spark.createDataFrame(gt, GT), spark.createDataFrame(system, SYSTEM), spark.createDataFrame(members, MEMBERS)).collect()}
    t, i = rows["person"]["tracking"], rows["person"]["reid"]
    assert (t["true_positives"], t["false_positives"], t["false_negatives"], t["id_switches"]) == (3, 1, 1, 0)
    assert (t["precision"], t["recall"], t["f1_score"], t["mota"]) == (0.75, 0.75, 0.75, 0.5)
    # P2's pair of cameras is missed although its sighting on b matches nothing.
    assert (i["true_positives"], i["false_positives"], i["false_negatives"]) == (1, 0, 1)
    assert [(c["camera"], c["true_positives"]) for c in rows["person"]["per_camera"]] == [("a", 2), ("b", 1)]
    v = rows["vehicle"]["tracking"]
    assert (v["true_positives"], v["false_negatives"], v["f1_score"], v["mota"]) == (0, 1, 0.0, 0.0)


def test_missed_pairs_come_from_the_truth(spark):
    claims = spark.createDataFrame([(1, 1, "a")], "identity long, gt long, camera string")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "gt long, camera string")
    assert reid_counts(claims).first()["false_negatives"] == 0 and reid_counts(claims, truth).first()["false_negatives"] == 1


def test_stored_entities(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    fields = "entity_id long, camera string, track_id long, entity_type string, description string, first_ts double, last_ts double, x1 double, y1 double, x2 double, y2 double, upper string, lower string, embedding array<double>"
    rows = [(i, c, 7, "person", "d", t, t + 5, 0.0, 0.0, 9.0, 9.0, "red", "blue", [1.0, 0.0] if i < 3 else [0.0, 1.0]) for i, c, t in ((1, "a", 0.0), (2, "b", 20.0), (3, "z", 0.0))]
    s.append_entities(spark.createDataFrame(rows, fields))
    s.append_history(spark.createDataFrame([(i, c, f) for i, c in ((1, "a"), (2, "b"), (3, "z")) for f in (0, 60, 120)], "entity_id long, camera string, frame_idx long"))
    truth = {"metadata": {"cameras": ["a", "b"]}, "persons": {"P1": {"appearances": [{"camera": "a", "frames": [0, 120]}, {"camera": "b", "frames": [0, 110]}]}}, "vehicles": {}}
    (tmp_path / "gt.json").write_text(json.dumps(truth))
    args = parser().parse_args(["--db", str(tmp_path / "db"), "evaluate", "--gt", str(tmp_path / "gt.json"), "--output", str(tmp_path / "out")])
    r = run(spark, args).first()
    assert (r["overall_tracking_f1"], r["overall_reid_f1"], r["person_mota"], r["vehicle_mota"]) == (0.5, 0.5, 1.0, 0.0)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    s.delete_camera("a")
    assert s.table("history").filter("camera = 'a'").count() == 0 and s.table("history").count() == 6
    assert overall(spark.read.json(str(tmp_path / "out"))).count() == 1


def test_clusters_in_reading_order(spark):
    boxes = [("a", 1, 0.9, 300.0, 50.0), ("a", 2, 0.5, 310.0, 55.0), ("a", 3, 0.8, 10.0, 50.0), ("a", 4, 0.7, 0.0, 0.0), ("b", 5, 0.1, 0.0, 0.0), ("b", 6, 0.2, None, 0.0)]
    d = spark.createDataFrame([(c, i, p, x, y, None if x is None else x + 20, y + 10) for c, i, p, x, y in boxes], "camera string, event_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    got = led_clusters(d, spatial_leaders(d, ["camera"], "event_id", 50.0), ["camera"], "event_id").collect()
    assert {(r["camera"], r["event_id"], r["num_detections"], r["place"]) for r in got} == {("a", 4, 1, 1), ("a", 3, 1, 2), ("a", 1, 2, 3), ("b", 5, 1, 1)}
