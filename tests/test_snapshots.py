"""Snapshot tables: appends, replaced partitions, lost writers and races; the history log that is built on them."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import grid
from tarnwatch.plans import daily
from tarnwatch.sources import snapshots, vendor
from tarnwatch.streaming import intake


def frame(spark, rows):
    return spark.createDataFrame(rows, "n int, day string")


def seen(spark, table, **bounds):
    return Counter((r["n"], r["day"]) for r in snapshots.read(spark, table, **bounds).collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_appends_are_read_whole_and_batches_once(spark, tmp_path):
    table = str(tmp_path / "t")
    assert snapshots.snapshot(spark, table) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, table)
    snapshots.append(frame(spark, [(1, "2024-01-01"), (2, None), (3, "odd=/ value")]), table, "day", "inbox", 0)
    first = snapshots.snapshot(spark, table)
    snapshots.append(frame(spark, [(4, "2024-01-02")]), table, "day", "inbox", 1)
    # A retried batch adds nothing, an empty one no entry; another source has its own count.
    assert snapshots.append(frame(spark, [(4, "2024-01-02")]), table, "day", "inbox", 1).number == 2
    snapshots.append(frame(spark, []), table, "day", "other", 0)
    assert seen(spark, table) == Counter([(1, "2024-01-01"), (2, None), (3, "odd=/ value"), (4, "2024-01-02")])
    assert seen(spark, table, at=first) == Counter([(1, "2024-01-01"), (2, None), (3, "odd=/ value")])
    assert snapshots.snapshot(spark, table).sources == {"inbox": 1, "other": 0}
    with pytest.raises(ValueError):
        snapshots.append(spark.createDataFrame([("x", "2024-01-01")], "n string, day string"), table, "day")


def test_bounds_leave_out_folders_and_reach_the_scan(spark, tmp_path):
    table = str(tmp_path / "t")
    snapshots.append(frame(spark, [(i, f"2024-01-{1 + i % 9:02d}") for i in range(90)]), table, "day")
    some = snapshots.read(spark, table, least="2024-01-04", largest="2024-01-05")
    assert some.count() == 20 and len(some.inputFiles()) <= 2 * len(snapshots.read(spark, table).inputFiles()) // 9 + 1
    filters = plan(some).split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and "2024-01-04" in filters
    whole = str(tmp_path / "numbers")
    snapshots.append(spark.range(30).select((F.col("id") % 11).cast("int").alias("k"), "id"), whole, "k")
    assert {r["k"] for r in snapshots.read(spark, whole, least=9).collect()} == {9, 10}


def test_replaced_partitions_and_lost_writers(spark, tmp_path):
    table = str(tmp_path / "t")
    for batch in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")]):
        snapshots.append(frame(spark, batch), table, "day")
    base = snapshots.snapshot(spark, table)
    summed = snapshots.read(spark, table).filter("day = 'a'").groupBy("day").agg(F.sum("n").cast("int").alias("n"))
    # A writer that dies between its files and the rename: every row is still read once.
    snapshots._written(summed, table, "day", base.number + 1)
    assert seen(spark, table) == Counter([(1, "a"), (2, "b"), (3, "a"), (4, "c")])
    # Rows that arrive while a partition is replaced stay beside the new ones.
    snapshots.append(frame(spark, [(9, "a")]), table, "day")
    snapshots.replace(summed, table, base, ["a"])
    assert seen(spark, table) == Counter([(4, "a"), (9, "a"), (2, "b"), (4, "c")])
    assert seen(spark, table, at=base) == Counter([(1, "a"), (2, "b"), (3, "a"), (4, "c")])
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(summed, table, base, ["a"])
    with pytest.raises(ValueError):
        snapshots.replace(frame(spark, [(1, "z")]), table, snapshots.snapshot(spark, table), ["a"])
    # Expiry: young folders stay; then all that the newest manifest does not name goes: the two old `a`, and what the lost
    # writer, the conflict and the strange partition left.
    assert snapshots.expire(spark, table, keep=1) == 0
    assert snapshots.expire(spark, table, keep=1, hours=-1) == 5
    assert seen(spark, table) == Counter([(4, "a"), (9, "a"), (2, "b"), (4, "c")])
    assert len(snapshots.numbers(spark, table)) == 1


def test_a_taken_number_starts_the_commit_again(spark, tmp_path, monkeypatch):
    table, real, raced = str(tmp_path / "t"), snapshots._renamed, []
    snapshots.append(frame(spark, [(1, "a")]), table, "day")

    def late(spark_, source, target):
        if not raced:
            raced.append(target)
            snapshots.append(frame(spark, [(2, "b")]), table, "day")  # takes the number first
        return real(spark_, source, target)

    monkeypatch.setattr(snapshots, "_renamed", late)
    assert snapshots.append(frame(spark, [(3, "c")]), table, "day").number == 3
    assert seen(spark, table) == Counter([(1, "a"), (2, "b"), (3, "c")])
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if p.name.startswith(".draft")]


def test_history_survives_a_killed_compaction(spark, tmp_path, monkeypatch):
    inbox, log = tmp_path / "inbox", str(tmp_path / "log")
    inbox.mkdir()

    def take(name, text):
        (inbox / name).write_text(text)
        intake.take_in(intake.inbox_stream(spark, str(inbox), ["Device", "Time", "x"]), "Time", log, str(tmp_path / "cp")).awaitTermination(60)

    def now(since=None):
        return {r["Time"]: r["x"] for r in intake.history(spark, log, "Device", "Time", since).collect()}

    take("a.csv", "Device,Time,x\nd,2024-01-01 00:00,1\nd,2024-01-01 00:10,2\nd,never,7\n")
    take("b.csv", "Device,Time,x\nd,2024-01-01 00:10,3\nd,2024-01-02 00:00,4\n")
    want = {"2024-01-01 00:00": "1", "2024-01-01 00:10": "3", "2024-01-02 00:00": "4", "never": "7"}
    assert now() == want and now("2024-01-02") == {"2024-01-02 00:00": "4", "never": "7"}
    assert intake.last_day(spark, log) == datetime.date(2024, 1, 2)
    assert "_day" in plan(intake.history(spark, log, "Device", "Time", "2024-01-02")).split("PartitionFilters: [")[1].split("]")[0]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_renamed", killed)
        with pytest.raises(KeyboardInterrupt):
            intake.compact_days(spark, log, "Device", "Time")
    assert now() == want and snapshots.read(spark, log).count() == 5
    assert intake.compact_days(spark, log, "Device", "Time") == ["2024-01-01"]
    assert now() == want and snapshots.read(spark, log).count() == 4
    assert intake.compact_days(spark, log, "Device", "Time") == []
    # A copy that arrives after the compaction still wins.
    take("c.csv", "Device,Time,x\nd,2024-01-01 00:10,5\n")
    assert now() == {**want, "2024-01-01 00:10": "5"}


def test_a_run_from_the_inbox_reads_the_last_days_of_the_log(spark, tmp_path, monkeypatch):
    """Two drops, the second with newer copies: what reaches the daily run, and the slots its first step makes of it."""
    inbox, given = tmp_path / "inbox", []
    inbox.mkdir()
    monkeypatch.setattr(daily, "daily_run", lambda export, mapping, models, weather, **options: given.append((export, options)) or {})
    names = {"station_id": "Device", "timestamp": "Time", "temperature": "T", "ph": "P", "turbidity": "N", "dissolved_oxygen": "O"}
    mapping = vendor.VendorMapping(columns=names)

    def drop(name, rows):
        lines = [",".join(names.values()), *(f"{d},{t},{x},7.5,3,8" for d, t, x in rows)]
        (inbox / name).write_text("\n".join(lines) + "\n")
        daily.inbox_run(spark, str(inbox), str(tmp_path / "log"), str(tmp_path / "cp"), mapping, None, window_hours=6)

    drop("a.csv", [("n", "2023-01-01 00:00", 1), ("n", "2024-01-01 00:00", 2), ("n", "2024-01-01 00:01", 3)])
    drop("b.csv", [("n", "2024-01-01 00:00", 4), ("n", "2024-02-10 00:00", 5)])
    export, options = given[-1]
    assert options == {"window_hours": 6} and {(r["Time"], r["T"]) for r in export.collect()} == {("2024-01-01 00:00", "4"), ("2024-01-01 00:01", "3"), ("2024-02-10 00:00", "5")}
    assert not [f for f in export.inputFiles() if "2023-01-01" in f]
    slots = grid.slot_grid(vendor.normalise(export, mapping)).filter("temperature IS NOT NULL").collect()
    # 00:00 came last as a newer copy, so the reading of 00:01 arrived first in its slot.
    assert sorted(r["temperature"] for r in slots) == [3.0, 5.0]
