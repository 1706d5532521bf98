"""Late data: batches in any order, a crash between queue and table, replays, rows that change their date."""

from pyspark.sql import functions as F

from tessera.streaming import late

SCHEMA = "id int, date string, v string, n int"
HOW = ("id", ["n"], "date", ["v"])
BATCHES = [
    [(1, "d1", "a", 0), (2, "d1", "b", 0), (3, "d2", "c", 0)],
    [(4, "d3", "d", 0), (1, "d1", "a2", 1), (1, "d1", "a1", 0)],
    [(1, "d1", "a1", 0), (2, "d1", "b", 1)],
    [(3, "d3", "c", 1), (5, "d4", None, 0)],
]


def state(spark, base):
    rows = {tuple(r[c] for c in ("id", "date", "v", "n")) for r in spark.read.schema(SCHEMA).parquet(f"{base}/table").collect()}
    return rows, {r.date: r.queued_at for r in late.queued(spark, base).collect()}


def test_batches_replays_and_a_crash(spark, tmp_path):
    base = f"file://{tmp_path}/x"
    made = [spark.createDataFrame(b, SCHEMA) for b in BATCHES]
    for i, b in enumerate(made[:3]):
        late.put(b, i, base, *HOW)
    rows, queue = state(spark, base)
    # an older value and one that is the same change nothing; the newer number of 2 is kept
    assert rows == {(1, "d1", "a2", 1), (2, "d1", "b", 1), (3, "d2", "c", 0), (4, "d3", "d", 0)} and queue == {"d1": 1, "d2": 0, "d3": 1}
    for i in (1, 2):
        late.put(made[i], i, base, *HOW)
    assert state(spark, base) == (rows, queue)
    # after a crash the queue's part is there, the table's isn't
    spark.createDataFrame([("d2", 3), ("d3", 3), ("d4", 3)], "date string, queued_at long").write.parquet(f"{base}/queue/batch=3")
    late.put(made[3], 3, base, *HOW)
    want = state(spark, base)
    assert want == ({(1, "d1", "a2", 1), (2, "d1", "b", 1), (3, "d3", "c", 1), (4, "d3", "d", 0), (5, "d4", None, 0)}, {"d1": 1, "d2": 3, "d3": 3, "d4": 3})
    late.put(made[3], 3, base, *HOW)
    assert state(spark, base) == want


def test_only_queued_dates_are_built_and_later_ones_stay(spark, tmp_path):
    base = f"file://{tmp_path}/y"
    seen = []

    def build(rows):
        seen.append(sorted(r.date for r in rows.select("date").distinct().collect()))
        return rows.groupBy("date").agg(F.count(F.lit(1)).alias("c"))

    table = lambda: spark.read.schema(SCHEMA).parquet(f"{base}/table")
    late.put(spark.createDataFrame(BATCHES[0], SCHEMA), 0, base, *HOW)
    late.drain(table(), base, "date", build)
    late.put(spark.createDataFrame(BATCHES[1], SCHEMA), 1, base, *HOW)
    out = late.drain(table(), base, "date", build)
    assert seen == [["d1", "d2"], ["d1", "d3"]] and {(r.date, r.c) for r in out.collect()} == {("d1", 2), ("d2", 1), ("d3", 1)}
    late.drain(table(), base, "date", build)
    assert seen[-1] == []


def files(base):
    return {str(p): p.stat().st_mtime_ns for p in (base / "table").glob("date=*/*.parquet")}


def test_dates_that_only_gain_keep_their_files_and_a_replay_writes_none(spark, tmp_path):
    base = f"file://{tmp_path}/z"
    late.put(spark.createDataFrame(BATCHES[0], SCHEMA), 0, base, *HOW)
    first = files(tmp_path / "z")
    more = spark.createDataFrame([(6, "d1", "f", 0), (7, "d3", "g", None)], SCHEMA)
    late.put(more, 1, base, *HOW)
    second = files(tmp_path / "z")
    assert first.items() <= second.items() and len(second) > len(first)
    late.put(more, 1, base, *HOW)
    assert files(tmp_path / "z") == second and len(state(spark, base)[0]) == 5
    # a null order is the oldest; d1 loses a row and is written anew, d2 isn't
    late.put(spark.createDataFrame([(7, "d3", "g2", 0), (6, "d1", "older", None), (1, "d3", "a", 1), (None, "d4", "n", 0)], SCHEMA), 2, base, *HOW)
    assert state(spark, base) == ({(1, "d3", "a", 1), (2, "d1", "b", 0), (3, "d2", "c", 0), (6, "d1", "f", 0), (7, "d3", "g2", 0), (None, "d4", "n", 0)}, {"d1": 2, "d2": 0, "d3": 2, "d4": 2})
    assert {n for n in first if n in files(tmp_path / "z")} < set(first)


def test_a_key_that_a_crash_left_on_two_dates_is_put_right(spark, tmp_path):
    base = f"file://{tmp_path}/c"
    late.put(spark.createDataFrame([(1, "d1", "a", 0), (2, "d1", "b", 0)], SCHEMA), 0, base, *HOW)
    moved = spark.createDataFrame([(1, "d2", "a", 1)], SCHEMA)
    # the new date was written, the old one not yet
    moved.write.mode("append").partitionBy("date").parquet(f"{base}/table")
    late.put(moved, 1, base, *HOW)
    assert state(spark, base) == ({(1, "d2", "a", 1), (2, "d1", "b", 0)}, {"d1": 1, "d2": 1})


def test_a_large_date_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(late, "FILE_ROWS", 100)
    base = f"file://{tmp_path}/w"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        late.put(spark.range(1000).selectExpr("cast(id as int) id", "'d1' date", "'v' v", "0 n"), 0, base, *HOW)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files(tmp_path / "w")) > 1 and len(state(spark, base)[0]) == 1000
