import random

import pytest

from driftspark.sources import artifacts, snapshots


def frame(spark, rows):
    return spark.createDataFrame([(p, h, n, f"t{n}") for p, h, n in rows], snapshots.SCHEMA)


def stored(df):
    return {r["dest_path"]: (r["sha256"], r["size_bytes"]) for r in df.collect()}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert snapshots.read_snapshot(spark, path) is None and snapshots.current_version(spark, path) is None
    rnd = random.Random(1)
    wanted = {f"p{n}": (f"h{n}", n) for n in range(2000)}
    assert snapshots.upsert_snapshot(frame(spark, [(p, *v) for p, v in wanted.items()]), path, buckets=64) == 0
    before = snapshots.read_manifest(spark, path)
    changed = {p: ("new", 5000) for p in rnd.sample(sorted(wanted), 6)} | {"q": ("h", 1)}
    assert snapshots.upsert_snapshot(frame(spark, [(p, *v) for p, v in changed.items()]), path, buckets=3) == 1
    after = snapshots.read_manifest(spark, path)
    moved = [b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)]
    assert after["buckets"] == 64 and 0 < len(moved) <= 7
    assert stored(snapshots.read_snapshot(spark, path)) == wanted | changed
    assert stored(snapshots.read_snapshot(spark, path, 0)) == wanted
    snapshots.drop_old_versions(spark, path)
    assert stored(snapshots.read_snapshot(spark, path)) == wanted | changed
    folders = {p.name for d in (tmp_path / "ledger" / "data").iterdir() for p in d.iterdir() if p.name.startswith("bucket")}
    assert len(folders) == len(after["folders"])
    # The readers of a ledger find it.
    assert stored(artifacts.read_ledger(spark, path)) == stored(artifacts.require_ledger(spark, path)) == wanted | changed


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    snapshots.upsert_snapshot(frame(spark, [("a", "1", 1)]), path, buckets=4)

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "_put_manifest", die)
    with pytest.raises(KeyboardInterrupt):
        snapshots.upsert_snapshot(frame(spark, [("a", "2", 2), ("b", "3", 3)]), path)
    monkeypatch.undo()
    assert stored(snapshots.read_snapshot(spark, path)) == {"a": ("1", 1)}
    # The next writer goes on from there, and what was left behind goes with the old versions.
    snapshots.upsert_snapshot(frame(spark, [("c", "4", 4)]), path)
    snapshots.drop_old_versions(spark, path)
    assert stored(snapshots.read_snapshot(spark, path)) == {"a": ("1", 1), "c": ("4", 4)}


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "ledger")
    snapshots.upsert_snapshot(frame(spark, [("a", "1", 1)]), path, buckets=4)
    manifest = snapshots.read_manifest(spark, path)
    snapshots.upsert_snapshot(frame(spark, [("b", "2", 2)]), path)
    with pytest.raises(snapshots.LedgerConflict):
        snapshots._put_manifest(spark, path, manifest | {"version": 1})
    assert stored(snapshots.read_snapshot(spark, path)) == {"a": ("1", 1), "b": ("2", 2)}
    assert snapshots.upsert_snapshot(frame(spark, []), path) == 2
