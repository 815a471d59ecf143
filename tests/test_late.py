"""Late rows of a stream go to a table of their own, and both tables add up to the input."""

import random

from tidemark.streaming import late

SCHEMA = "symbol string, ts_ms long, n long"


def _wanted(batches, lateness):
    clock, kept, held = {}, [], []
    for rows in batches:
        for r in rows:
            behind = None if r[1] is None or r[0] not in clock else clock[r[0]] - r[1]
            (held if r[1] is None or (behind is not None and behind > lateness) else kept).append((r, behind))
        for s, t, _ in rows:
            if t is not None:
                clock[s] = max(clock.get(s, t), t)
    return kept, held


def test_late_rows_are_kept_apart_and_add_up(spark, tmp_path):
    rng = random.Random(3)
    times = [(rng.choice(["A", "A", "A", "B", None]), 1000 * k + rng.randrange(-4000, 4000), k) for k in range(120)]
    batches = [times[k : k + 30] for k in range(0, 120, 30)]
    batches[1].append(("A", None, 200))  # a row without a time
    batches[2] += [("A", 1, 201), ("A", 1, 202), ("C", 1, 203)]  # late twice; a symbol without a clock is in time
    batches[3].append(("B", 1, 204))
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    rows = [r for b in batches for r in b]
    for number, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = stream.writeStream.foreachBatch(late.router(out, 3000)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert (tmp_path / "out" / "clocks" / f"batch={number}").exists() and not (tmp_path / "out" / "clocks" / f"batch={number + 1}").exists()
    kept, held = _wanted(batches, 3000)
    assert held and any(r[0] == "B" for r, _ in held)
    got_kept = {tuple(r) for r in spark.read.parquet(f"{out}/on_time").select("symbol", "ts_ms", "n").collect()}
    got_held = {(r["n"], r["behind_ms"]) for r in spark.read.parquet(f"{out}/late").collect()}
    assert got_kept == {r for r, _ in kept}
    assert got_held == {(r[2], behind) for r, behind in held}
    counts = {r["symbol"]: (r["on_time"], r["late"]) for r in late.late_counts(spark, out).collect()}
    assert sum(a + b for a, b in counts.values()) == len(rows)
    assert all(counts[s] == (sum(r[0] == s for r, _ in kept), sum(r[0] == s for r, _ in held)) for s in counts)


def test_a_batch_run_again_replaces_its_files(spark, tmp_path):
    step, out = late.router(str(tmp_path / "out"), 10), str(tmp_path / "out")
    first, second = spark.createDataFrame([("A", 100, 1)], SCHEMA), spark.createDataFrame([("A", 80, 2), ("A", 95, 3)], SCHEMA)
    step(first, 0)
    step(second, 1)
    step(second, 1)
    assert [tuple(r) for r in late.late_counts(spark, out).collect()] == [("A", 2, 1, 20)]


def test_an_empty_first_batch(spark, tmp_path):
    step, out = late.router(str(tmp_path / "out"), 10), str(tmp_path / "out")
    step(spark.createDataFrame([], SCHEMA), 0)
    step(spark.createDataFrame([("A", 5, 1)], SCHEMA), 1)
    assert [tuple(r)[:3] for r in late.late_counts(spark, out).collect()] == [("A", 1, 0)]
