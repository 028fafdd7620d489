import json

import pytest
from pyspark.sql import functions as F
from rankforge.sources import splits


def test_split_files_are_whole_or_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train", "x"), (2, "a", "val", None), (3, "b", "train", "é\n")], "k long, f string, s string, text string")
    path = f"{tmp_path}/out"
    assert sorted(map(tuple, splits.write_splits(df, path, "f", "s").collect())) == [("a", "train", 1), ("a", "val", 1), ("b", "train", 1)]
    with pytest.raises(FileExistsError):
        splits.write_splits(df.where("k = 1"), path, "f", "s")
    read = lambda *a: sorted((r["k"], r["family"], r["text"]) for r in splits.read_splits(spark, path, "k long, text string, family string, split string", *a).collect())
    assert read() == [(1, "a", "x"), (2, "a", None), (3, "b", "é\n")] and read("train") == [(1, "a", "x"), (3, "b", "é\n")]
    broken = df.withColumn("k", F.when(F.col("k") < 3, F.col("k")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):  # a write that fails changes nothing
        splits.write_splits(broken, path, "f", "s", overwrite=True)
    assert len(read()) == 3
    assert [tuple(r) for r in splits.write_splits(df.where("k = 3"), path, "f", "s", overwrite=True).collect()] == [("b", "train", 1)] and read() == [(3, "b", "é\n")]
    assert not [p for p in tmp_path.iterdir() if "old" in p.name]


def test_runs_in_order(spark, tmp_path):
    line = lambda **x: json.dumps({"phase": "train", "sample_id": "s"} | x)
    runs = {"b": ('{"created_at_utc": "2024-01-02"}', [line(step=1, index=5), "", line(phase="test", index=9)]), "a": ('{"created_at_utc": "2024-01-03"}', [line(label="L"), line(epoch=2), line(sample_id="")]), "c": (None, [line(step=1, index=7), line(phase="test_summary")]), "d": ("{}", [line()])}
    for name, (manifest, lines) in runs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "train_results.jsonl").write_text("\n".join(lines) + "\n")
        if manifest:
            (tmp_path / name / "run_manifest.json").write_text(manifest)
    (tmp_path / "empty").mkdir()
    assert [r["run"] for r in splits.run_sources(spark, str(tmp_path), "train_results.jsonl").orderBy("place").collect()] == ["b", "a", "c", "d"]
    schema = "phase string, label string, step long, epoch long, sample_id string, index long"
    found = splits.read_runs(spark, str(tmp_path), "train", schema)
    told = sorted((r["place"], r["label"]) for r in found.collect())
    assert told == [(0, "after 1 training samples"), (1, "L"), (1, "epoch 2"), (2, "after 1 training samples"), (3, "unlabeled")]
    assert {(r["label"], r["run"]) for r in splits.last_runs(found, "label").collect()} == {("after 1 training samples", "c"), ("L", "a"), ("epoch 2", "a"), ("unlabeled", "d")}
    (tmp_path / "d" / "train_results.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="unreadable line in .*d/train_results"):
        splits.read_runs(spark, str(tmp_path), "train", schema).collect()
