"""Season store: written bytes follow the batch, replays, moved matches, delta log, crashes."""

import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitchside.operators import upsert as U
from pitchside.operators.season_store import SeasonStore
from pitchside.sources.store import STORE_SCHEMA


def row(i, day, score=1):
    return (i, day, "15:00", "L", f"H{i}", f"A{i}", score, 0, "FINISHED", 2.0, 3.0, 4.0)


def frame(spark, rows, seq):
    """A stamped batch; later rows of the list win."""
    data = [(*r, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields) + ", o long")
    return U.stamp(df, seq, "o").drop("o")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def model(batches):
    """The expected store: a dict by key."""
    out = {}
    for rows in batches:
        for r in rows:
            out[r[0]] = r
    return sorted(out.values())


def test_an_upsert_writes_only_its_seasons(spark, tmp_path):
    base = str(tmp_path / "store")
    store = SeasonStore(spark, base)
    assert store.init() == 0 and store.init() == 0 and store.read().count() == 0
    first = [row(1000 * y + i, date(y, 1 + i % 12, 3)) for y in range(2015, 2023) for i in range(400)]
    store.upsert(frame(spark, first, 0), 0)
    before, whole = store.manifest(), size(base)
    batch = [row(2018_001, date(2018, 5, 5), 7), row(2018_001, date(2018, 5, 5), 8), row(99, date(2018, 6, 6))]
    version = store.upsert(frame(spark, batch, 1), 1)
    after = store.manifest()
    assert {n for n in after["seasons"] if after["seasons"][n] != before["seasons"].get(n)} == {"2018"}
    assert size(base) - whole < whole / 3                         # one of eight seasons
    assert content(store.read()) == model([first, batch])
    # a replay leaves one version; older versions stay readable
    assert store.upsert(frame(spark, batch, 1), 1) == version == store.versions()[-1] == 2
    assert content(store.read(1)) == model([first])


def test_a_moved_match_leaves_its_old_season(spark, tmp_path):
    store = SeasonStore(spark, str(tmp_path))
    first = [row(i, date(2000 + i % 3, 1, 1)) for i in range(9)] + [row(50, None)]
    store.upsert(frame(spark, first, 0), 0)
    moved = [row(3, date(2002, 9, 9)), row(50, date(2001, 2, 2)), row(1, None)]
    store.upsert(frame(spark, moved, 1), 1)
    assert content(store.read()) == sorted(model([first, moved]), key=lambda r: r[0])
    assert {n: s["rows"] for n, s in store.manifest()["seasons"].items()} == {"2000": 2, "2001": 3, "2002": 4, "undated": 1}
    alone = [row(1, date(2000, 1, 1))]
    store.upsert(frame(spark, alone, 2), 2)                       # the undated season is left without rows
    assert "undated" not in store.manifest()["seasons"] and store.read().count() == 10
    assert store.upsert(frame(spark, [], 3), 3) == 4 and store.read().count() == 10


def test_delta_log_equals_batches_and_compaction_changes_nothing(spark, tmp_path):
    rnd, base = random.Random(4), str(tmp_path)
    store = SeasonStore(spark, base)
    batches = [[row(rnd.randrange(60), date(2010 + rnd.randrange(4), 1 + rnd.randrange(12), 1), rnd.randrange(9)) for _ in range(40)]
               for _ in range(6)]
    sizes = []
    for k, rows in enumerate(batches):
        was = size(base) if os.path.exists(base) else 0
        store.append(frame(spark, rows, k), k)
        sizes.append(size(base) - was)
        store.append(frame(spark, rows, k), k)                    # replayed: skipped
        assert content(store.read()) == model(batches[:k + 1])
        if k == 3:
            with pytest.raises(RuntimeError, match="compact"):
                store.upsert(frame(spark, rows, 99), 99)
            store.compact()
            assert store.manifest()["deltas"] == [] and content(store.read()) == model(batches[:4])
            assert store.compact() == store.versions()[-1]
    assert max(sizes) < 2 * min(sizes)                            # a micro-batch costs the same on an empty and a full store
    assert len(store.manifest()["deltas"]) == 2


def test_a_compaction_cut_off_in_the_middle_changes_nothing(spark, tmp_path, monkeypatch):
    store = SeasonStore(spark, str(tmp_path))
    rows = [row(i, date(2010 + i % 3, 1, 1)) for i in range(30)]
    store.append(frame(spark, rows, 0), 0)
    version = store.versions()[-1]
    monkeypatch.setattr(SeasonStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("executor lost")))
    with pytest.raises(OSError):
        store.compact()                                           # all data is written, the manifest is not
    monkeypatch.undo()
    assert store.versions()[-1] == version and content(store.read()) == model([rows])
    assert store.compact() == version + 1 and content(store.read()) == model([rows])


def test_two_writers_of_one_version_do_not_overwrite_each_other(spark, tmp_path):
    store = SeasonStore(spark, str(tmp_path))
    store.init()
    late = {**store.manifest(), "version": 1, "last_batch": 5}
    store.append(frame(spark, [row(1, date(2020, 1, 1))], 0), 0)
    with pytest.raises(RuntimeError, match="another job"):
        store._commit(late)
    assert store.read().count() == 1


def test_large_batches_join_by_shuffle(spark, tmp_path, monkeypatch):
    from pitchside.operators import season_store

    monkeypatch.setattr(season_store, "KEY_ROWS", 0)
    store = SeasonStore(spark, str(tmp_path))
    first = [row(i, date(2000 + i % 3, 1, 1)) for i in range(30)]
    store.upsert(frame(spark, first, 0), 0)
    second = [row(i, date(2000 + i % 2, 1, 1), 5) for i in range(10, 40)]
    store.append(frame(spark, second, 1), 1)
    assert content(store.read()) == model([first, second])
    store.compact()
    assert content(store.read()) == model([first, second])
    assert store.read().where(F.col("home_score") == 5).count() == 30
