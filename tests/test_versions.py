"""Commits over several tables: whole or not at all."""

import uuid

import pytest
from pyspark.sql import functions as F

from rallyplan.session import checkpoint_folder
from rallyplan.sources.versions import Conflict, Store, save_analysis


@pytest.fixture
def store(spark):
    return Store(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")


def frames(spark, rows):
    shots = spark.createDataFrame(rows, "session_id long, shot_id long, stroke string")
    return {"shots": shots, "metrics": shots.select("session_id", "shot_id", F.length("stroke").alias("value"))}


def told(store, table, version=None):
    return sorted(map(tuple, store.read(table, version).collect()), key=str)


def test_a_commit_replaces_its_keys_in_all_its_tables(spark, store):
    assert store.version() == 0
    first = [(1, 10, "serve"), (1, 11, "volley"), (2, 20, "serve"), (None, 30, "serve"), (3, 40, "x")]
    assert store.commit(frames(spark, first)) == 1
    assert told(store, "shots") == sorted(first, key=str)
    again = frames(spark, [(1, 12, "lob"), (None, 31, "lob")])
    assert store.commit(again, replaced=spark.createDataFrame([(3,), (99,)], "session_id long")) == 2
    want = [(1, 12, "lob"), (2, 20, "serve"), (None, 31, "lob")]
    assert told(store, "shots") == sorted(want, key=str)
    assert told(store, "metrics") == sorted([(s, i, len(x)) for s, i, x in want], key=str)
    assert told(store, "shots", 1) == sorted(first, key=str)  # the version before is still there
    # a commit of one table leaves the others alone
    store.commit({"shots": frames(spark, [(2, 21, "drop")])["shots"]})
    assert (2, 21, "drop") in told(store, "shots") and (2, 20, 5) in told(store, "metrics")
    with pytest.raises(KeyError):
        store.read("rallies")


@pytest.mark.parametrize("bad", ["shots", "metrics"])
def test_what_fails_on_the_way_changes_nothing(spark, store, bad):
    store.commit(frames(spark, [(1, 10, "serve"), (2, 20, "serve")]))
    new = frames(spark, [(1, 11, "lob")])
    new[bad] = new[bad].withColumn("shot_id", F.when(F.col("shot_id") > 0, F.raise_error("lost").cast("long")))
    with pytest.raises(Exception, match="lost"):
        store.commit(new)
    assert store.version() == 1 and told(store, "shots") == [(1, 10, "serve"), (2, 20, "serve")] and len(told(store, "metrics")) == 2
    # what it had written is never read, and goes with the next vacuum
    assert store.commit(frames(spark, [(1, 12, "lob")])) == 2
    assert told(store, "shots") == [(1, 12, "lob"), (2, 20, "serve")]
    before = store.vacuum(keep=2)
    assert all(x.startswith(("shots/", "metrics/")) for x in before)
    assert told(store, "shots") == [(1, 12, "lob"), (2, 20, "serve")] and told(store, "shots", 1)


def test_a_failure_before_the_version_file_changes_nothing(spark, store, monkeypatch):
    store.commit(frames(spark, [(1, 10, "serve")]))
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.commit(frames(spark, [(1, 11, "lob")]))
    assert told(store, "shots") == [(1, 10, "serve")]


def test_of_two_commits_from_one_version_the_second_fails(spark, store):
    store.commit(frames(spark, [(1, 10, "serve")]))
    store.commit(frames(spark, [(2, 20, "serve")]), base=1)
    with pytest.raises(Conflict):
        store.commit(frames(spark, [(3, 30, "serve")]), base=1)
    assert store.version() == 2 and [r[0] for r in told(store, "shots")] == [1, 2]


def test_compact_and_vacuum(spark, store):
    for i in range(4):
        store.commit(frames(spark, [(i % 3, 10 * i, "serve")]))
    rows = told(store, "shots")
    assert len(store.manifest()["tables"]["shots"]["commits"]) == 3
    store.compact()
    assert told(store, "shots") == rows and len(store.manifest()["tables"]["shots"]["commits"]) == 1
    gone = store.vacuum()
    assert sum(x.startswith("shots/") for x in gone) == 4 and told(store, "shots") == rows
    with pytest.raises(Exception, match="1.json"):
        store.read("shots", 1)


def test_empty_and_other_columns(spark, store):
    none = {k: v.limit(0) for k, v in frames(spark, [(1, 10, "serve")]).items()}
    store.commit(none)
    assert told(store, "shots") == [] and store.read("shots").columns == ["session_id", "shot_id", "stroke"]
    with pytest.raises(ValueError):
        store.commit({"shots": none["shots"].drop("stroke")})


def test_readers_open_live_commits_only(spark, store):
    store.commit(frames(spark, [(1, 10, "serve")]))
    store.commit(frames(spark, [(1, 11, "lob")]))
    files = store.read("shots").inputFiles()
    assert files and len({f.split("commit=")[1].split("/")[0] for f in files if "commit=" in f}) == 1


def test_save_analysis(spark, store):
    shots = spark.createDataFrame([(1, 10), (2, 20)], "session_id long, shot_id long")
    metrics = spark.createDataFrame([(10, "knee", 1.0), (20, "knee", 2.0)], "shot_id long, name string, value double")
    rallies = spark.createDataFrame([(1, 0)], "session_id long, rally long")
    sessions = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    save_analysis(store, shots, metrics, rallies, sessions)
    save_analysis(store, shots.limit(0), metrics.limit(0), rallies.limit(0), sessions.where("session_id = 2"))
    assert told(store, "shots") == [(1, 10)] and store.read("metrics").select("session_id", "value").collect() == [(1, 1.0)]


def test_a_library_reads_one_version(spark, store):
    """Rallies and shots that are committed together are seen together, also by a library that was opened before."""
    from rallyplan import api

    shot = lambda i, stroke: (1, i, 5, float(i), stroke)
    commit = lambda rows: store.commit({
        "shot": spark.createDataFrame(rows, "session_id long, id long, player_id long, t double, stroke string"),
        "rally": spark.createDataFrame([(1, 0, len(rows))], "session_id long, index long, shot_count long"),
        "shot_metric": spark.createDataFrame([(1, r[1], "knee", 1.0) for r in rows], "session_id long, shot_id long, name string, value double"),
    })
    commit([shot(1, "serve"), shot(2, "lob")])
    before = api.Library(spark, "/nowhere", store)
    commit([shot(3, "serve")])
    after = api.Library(spark, "/nowhere", store)
    for lib, ids in ((before, [1, 2]), (after, [3])):
        rows = lib.shots(1).collect()
        assert [r.id for r in rows] == ids and all(r.metrics == {"knee": 1.0} and r.speed_kmh is None for r in rows)
        assert lib.rallies(1).first().shot_count == len(ids)
