"""Snapshots: published last, checked on load, bootstrapped into a store; truncated bootstrap; reconciliation."""

import pytest
from pyspark.sql import functions as F

from blockloom.operators import epochs, snapshot
from blockloom.sources import versions
from tests.ledger import as_sets, build


@pytest.fixture
def exported(spark, tmp_path):
    path, tables = str(tmp_path / "snap"), build(spark, range(1, 9))
    tables["sync_halt"] = spark.createDataFrame([(1,)], "x int")  # never exported
    snapshot.export_snapshot(spark, tables, path, 8)
    return tmp_path / "snap", tables


def parts(folder):
    return sorted(p for p in folder.glob("part-*.parquet") if p.stat().st_size)


def test_round_trip_and_bootstrap(spark, tmp_path, exported):
    path, tables = exported
    height, loaded = snapshot.load_snapshot(spark, str(path))
    assert height == 8 and set(loaded) == set(tables) - {"sync_halt"}
    assert as_sets(loaded) == as_sets({t: tables[t] for t in loaded})
    with pytest.raises(FileExistsError):
        snapshot.export_snapshot(spark, tables, str(path), 9)
    root = str(tmp_path / "db")
    old = build(spark, range(1, 3)) | {"sync_halt": spark.createDataFrame([(7,)], "x int"), "orders": spark.createDataFrame([(1,)], "action_index bigint")}
    versions.write_version(spark, root, old, 2)
    assert snapshot.bootstrap(spark, root, str(path)) == 1
    got = versions.read_tables(spark, root, 1)
    assert as_sets({t: got[t] for t in loaded}) == as_sets(loaded)
    assert got["sync_halt"].first().x == 7 and got["orders"].count() == 0


def test_damage_is_refused(spark, tmp_path, exported):
    path, _ = exported
    credits = parts(path / "credits")
    (path / "marker").write_bytes((path / snapshot.MARKER).read_bytes())
    whole = credits[0].read_bytes()
    for p in path.glob("credits/.*crc"):
        p.unlink()
    middle = whole.index(b"1000")
    credits[0].write_bytes(whole[:middle] + b"9" + whole[middle + 1:])
    with pytest.raises(snapshot.DamagedSnapshot):
        snapshot.load_snapshot(spark, str(path))
    credits[0].unlink()
    with pytest.raises(snapshot.DamagedSnapshot, match="credits"):
        snapshot.load_snapshot(spark, str(path))
    credits[0].write_bytes(whole)
    assert snapshot.load_snapshot(spark, str(path))[0] == 8
    for p in path.glob(".*crc"):
        p.unlink()
    (path / snapshot.MARKER).write_text('{"height": 8, "tab')
    with pytest.raises(snapshot.DamagedSnapshot, match="torn"):
        snapshot.load_snapshot(spark, str(path))
    (path / snapshot.MARKER).unlink()
    with pytest.raises(snapshot.DamagedSnapshot, match="never published"):
        snapshot.load_snapshot(spark, str(path))


def test_window_with_ids_that_came_late(spark):
    full = build(spark, range(1, 30))
    full["index_addresses"] = spark.createDataFrame([(i, f"a{i}", 4 if i == 3 else None) for i in range(6)], "id bigint, address string, owner_id bigint")
    views = []

    def source():
        views.append(1)
        return full

    paged = {"index_addresses": full["index_addresses"].where("id < 3")}
    base, data, _, lookups = snapshot.bootstrap_window(paged, source, 1, None, "TOKEN", spark.createDataFrame([(1, "valid")], "id bigint, status string"))
    # blocks 28 and 29 pay addresses 3 and 4; address 5 is never pointed at
    assert base == 28 and sorted(r.block_index for r in data["blocks"].collect()) == [28, 29]
    assert sorted(r.id for r in lookups["index_addresses"].collect()) == [0, 1, 2, 3, 4] and len(views) >= 2


def test_reconcile_writes_the_difference(spark, tmp_path):
    root = str(tmp_path / "db")
    frame = lambda rows: spark.createDataFrame(rows, "tx int, address int, status string")
    versions.write_version(spark, root, {"dispensers": frame([(1, 1, "open"), (2, 1, None), (3, 1, "open"), (None, 4, "n")])}, 5)
    source = frame([(1, 1, "open"), (2, 1, "expired"), (9, 9, None), (None, 4, "n")])
    assert {(r.action, r.tx) for r in snapshot.reconcile_diff(versions.read_table(spark, root, "dispensers"), source, ["tx", "address"]).collect()} == {
        ("keep", 1), ("update", 2), ("insert", 9), ("keep", None), ("delete", 3)}
    assert snapshot.reconcile(spark, root, "dispensers", source, ["tx", "address"], 1) == 1
    assert as_sets({"d": versions.read_table(spark, root, "dispensers")}) == as_sets({"d": source})
    assert snapshot.reconcile(spark, root, "dispensers", source.limit(0), ["tx", "address"], 1) is None  # the same generation again
    assert snapshot.reconcile(spark, root, "dispensers", source, ["tx", "address"], 2) is None  # nothing differs
    assert snapshot.last_generation(spark, root, "dispensers") == 1
    assert versions.read_table(spark, root, "dispensers").where(F.col("tx") == 9).count() == 1


def test_markers_over_two_reorgs(spark):
    prunes = spark.createDataFrame([(10, 1, "a"), (12, 1, "a"), (30, 1, "b"), (11, 2, "x")], "seq int, epoch int, old_root string")
    commits = spark.createDataFrame([(1, 1, "a"), (2, 2, "x"), (20, 1, "b"), (40, 1, "c")], "seq int, epoch int, merkle_root string")
    assert sorted(map(tuple, epochs.marker_chain(prunes, commits).collect())) == [(10, 1, "a", "b"), (11, 2, "x", None), (30, 1, "b", "c")]
