"""Settings, the pose seam, online tracking, the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan import __main__ as cli
from rallyplan.operators.tracking import PeopleTracker
from rallyplan.schema import KEYPOINTS, Thresholds
from rallyplan.sources import media
from rallyplan.streaming.tracks import tracked


def test_settings():
    assert Thresholds.of(rally_gap_s=4).rally_gap_s == 4
    with pytest.raises(ValueError, match="unknown settings: gap"):
        Thresholds.of(gap=1)
    with pytest.raises(ValueError, match="not numbers"):
        Thresholds.of(rally_gap_s="4")


def test_pose_backend(spark):
    @media.register("fake")
    def fake():
        def model(frames):
            return [[media.Person((0.0, 0.0, 1.0, 2.0), c / 10, [(float(c), 2.0, 0.9)] * 17) for c in raw] for raw in frames]

        return model

    frames = spark.createDataFrame([(1, i, i / 25, bytearray([1, 9])) for i in range(20)], "video_id long, frame_idx long, t double, image binary")
    out = media.find_people(frames, media.BACKENDS["fake"], batch=3).collect()
    assert len(out) == 20 and out[0].kp_x == [9.0] * len(KEYPOINTS) and round(out[0].conf, 3) == 0.9


def test_tracking_goes_on_from_trigger_to_trigger(spark, tmp_path):
    pick = np.random.default_rng(5)
    rows = []
    for f in range(40):
        for d, y in enumerate(pick.permutation([-11.0, 11.0])):
            rows.append((1, f, d, f / 10, [0.02 * f, float(y)], [0.0, 0.0, 1.0, 2.0], [1.0, 0.0] if y < 0 else [0.0, 1.0]))
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, detection long, t double, foot array<double>, box array<double>, look array<double>")
    for n, part in enumerate((df.where("frame_idx < 20"), df.where("frame_idx >= 20"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = tracked(source).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.frame_idx, r.detection): r.track for r in spark.table("tracks").collect()}
    tracker, want = PeopleTracker(), {}
    for f in range(40):
        own = [r for r in rows if r[1] == f]
        ids = tracker.frame(f / 10, [tuple(np.array(x, float) for x in r[4:]) for r in own])
        want |= {(f, r[2]): i for r, i in zip(own, ids, strict=True)}
    assert got == want and set(got.values()) == {0, 1}


def test_command_line(capsys, monkeypatch, spark, tmp_path):
    assert cli.main(["queries"]) == 0
    assert "rally_table:" in capsys.readouterr().out
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    cli.main(["run", "rally_table", "/root/testdata/sf0.001", "--rows", "2"])
    assert "start_s" in capsys.readouterr().out
    (tmp_path / "l.csv").write_text("t\n10\n20\n")
    spark.createDataFrame([(10.1,), (40.0,)], "t double").select(F.col("t")).write.parquet(str(tmp_path / "f"))
    cli.main(["eval-hits", str(tmp_path / "l.csv"), str(tmp_path / "f")])
    assert "recall" in capsys.readouterr().out
