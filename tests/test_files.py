import hashlib
import json

import pytest

from flowlens.operators.flows import FEATURES
from flowlens.sources import files


def test_feature_files(spark, tmp_path):
    rules = spark.createDataFrame([("benign", 0, None), ("scan", 1, "recon")], "alias string, binary_label int, family string")
    head = ",".join([*files.FEATURE_METADATA, *FEATURES])
    row = lambda i, at="2026-01-01T00:00:00Z", label="Benign", v="1.5": ",".join([f"r{i}", "c", "s", "g", str(i), at, label, *([v] * len(FEATURES))])
    lines = [head, row(1), row(2, label=" SCAN "), row(3, at="2026-01-01T00:00:00"), row(4, v="nan"), row(5, label="what"), row(6).replace("r6", " "), row(7, v="x")]
    (tmp_path / "a file.csv").write_text("\n".join(lines) + "\n")
    got = files.convert_feature_csv(spark, str(tmp_path), rules, "d", "1").orderBy("original_row_id").collect()
    assert [r["error"] for r in got] == [None, None, "observed_at", "feature:total_packets", "unmapped_label", "missing:record_id", "feature:total_packets"]
    assert (got[1]["binary_label"], got[1]["family"], got[0]["total_bytes"], got[0]["dataset_id"]) == (1, "recon", 1.5, "d")
    assert got[0]["source_file"] == "a file.csv" and got[0]["source_file_checksum"] == hashlib.sha256((tmp_path / "a file.csv").read_bytes()).hexdigest()
    (tmp_path / "b.csv").write_text(head.replace("total_packets,total_bytes", "total_bytes,total_packets") + "\n" + row(1) + "\n")
    with pytest.raises(ValueError, match="header"):
        files.convert_feature_csv(spark, str(tmp_path / "b.csv"), rules, "d", "1")


def test_exports_are_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([(3, "x", 2), (1, "y", 1), (2, "x", 1)], "id long, verdict string, at long")
    manifest = files.write_export(rows.repartition(3), str(tmp_path), "v1", ("verdict",), "id", ("at", "id"))
    got = {(r["what"], r["value"]): r["n"] for r in manifest.collect() if r["what"] != "ids"}
    assert got == {("verdict", "x"): 2, ("verdict", "y"): 1}
    written = [json.loads(x)["id"] for f in sorted((tmp_path / "v1/rows").glob("*.json")) for x in f.read_text().split("\n") if x]
    assert written == [1, 2, 3]
    with pytest.raises(FileExistsError):
        files.write_export(rows, str(tmp_path), "v1", ("verdict",), "id", ("at",))
    again = files.write_export(rows, str(tmp_path), "v2", (), "id", ("at",)).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in manifest.where("what = 'ids'").collect()]


def test_metric_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("mode,recall,f1,macro_f1,pr_auc,false_positive_rate,tn,fp,fn,tp,extra\nfusion,1,0.5,0.5,0.5,0,1,2,3,4,z\n ,1,1,1,1,1,1,1,1,1,\nanomaly,inf,1,1,1,1,1,1,1,1,\nx,1,1,1,1,1,1,1.5,1,1,\n")
    got = files.read_metric_csv(spark, str(tmp_path / "m.csv"), "known").collect()
    assert [r["error"] for r in got] == [None, "mode", "recall", "fp"] and got[0]["tp"] == 4 and "extra" not in got[0].asDict()
    with pytest.raises(ValueError, match="lacks"):
        files.read_metric_csv(spark, str(tmp_path / "m.csv"), "intervals")
    with pytest.raises(ValueError, match="no table"):
        files.read_metric_csv(spark, str(tmp_path / "m.csv"), "other")
