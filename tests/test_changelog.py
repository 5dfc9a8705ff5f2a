import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import batches, changelog, metrics, relate
from palimpsest.streaming.lifecycle import deduplicated, run_available, running_summary, windowed_counts

LOG = "key string, seq timestamp, idx long, op string, attr string, value double"


def made(spark, seed=1, n=300):
    rng = random.Random(seed)
    ops = ["CREATE", "ALTER", "ALTER", "DROP", "INSERT"]
    rows = [(f"k{rng.randrange(12)}", i, rng.choice(ops), rng.choice(["a", "b", "c", None]), float(rng.randrange(200))) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(k, None, i, o, a, v) for k, i, o, a, v in rows], LOG).withColumn(
        "seq", F.timestamp_seconds(F.col("idx") * 60 + 86_400)
    )


def histories(rows):
    out = {}
    for k, i, o, a, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, o, a, v))
    return out


def test_last_state_and_segment(spark):
    rows, log = made(spark)
    want = {}
    for k, h in histories(rows).items():
        creates = [x for x in h if x[1] == "CREATE"]
        if h[-1][1] != "DROP" and creates:
            want[k] = creates[-1][0]
    assert {r["key"]: r["idx"] for r in changelog.last_state(log).collect()} == want
    after = {(k, x[0]) for k, h in histories(rows).items() for x in h[max([n for n, y in enumerate(h) if y[1] == "DROP"], default=-1) + 1 :]}
    assert {(r["key"], r["idx"]) for r in changelog.since_last_drop(log).collect()} == after


def test_redundancy_patterns(spark):
    rows = [("a", 1, "CREATE"), ("a", 2, "ALTER"), ("a", 3, "ALTER"), ("b", 1, "CREATE"), ("b", 2, "DROP"), ("b", 3, "CREATE"),
            ("c", 1, "CREATE"), ("c", 2, "CREATE"), ("d", 1, "CREATE"), ("d", 2, "ALTER"), ("d", 3, "INSERT"), ("e", 1, "CREATE")]
    log = spark.createDataFrame([(k, None, i, o, None, 0.0) for k, i, o in rows], LOG).withColumn("seq", F.timestamp_seconds("idx"))
    got = {r["key"]: tuple(r)[1:] for r in changelog.redundancy(log, F.col("idx")).collect()}
    assert got == {"a": ("CREATE_ALTER", 2, 2, 4), "b": ("DROP_CREATE", 1, 2, 3), "c": ("DUPLICATE", 1, 2, 5)}


def test_ladder_levels_are_nested():
    ladders = [changelog.ladder(level) for level in changelog.LEVELS]
    assert all(set(a) <= set(b) for a, b in zip(ladders, ladders[1:]))
    assert all(x[-1] == "error_recovery" for x in ladders)
    assert "create_alter" not in changelog.ladder("standard", {"create_alter": False})
    assert "drop_create_cycle" in changelog.ladder("paranoid", {"drop_create_cycle": True})
    assert changelog.ladder("standard", {"error_recovery": False})[-1] == "error_recovery"
    with pytest.raises(ValueError):
        changelog.ladder("standard", {"nothing": True})
    with pytest.raises(ValueError):
        changelog.ladder("bold")


def test_plan_never_grows(spark):
    _, log = made(spark, 2)
    for level in changelog.LEVELS:
        plan = changelog.compaction_plan(log, level)
        assert plan.where("n_after > n_before").count() == 0 and plan.count() == 12
    assert changelog.compaction_plan(log, "paranoid").where("rule != 'error_recovery'").count() == 0
    assert metrics.reduction(changelog.compaction_plan(log.where("false"), "standard")).first()["reduction_pct"] == 0.0


def test_batches_by_brute_force(spark):
    rows, log = made(spark, 3)
    own = log.withColumn("target", F.col("attr"))
    got = {(r["key"], r["idx"]): r["batch"] for r in batches.in_batches(own, "key", F.col("op") == "INSERT", "seq", "idx").collect()}
    for k, h in histories(rows).items():
        batch, closed = 0, True
        for i, op, *_ in h:
            if closed or op == "INSERT":
                batch += 1
            closed = op == "INSERT"
            assert got[k, i] == batch


def test_asof_and_range_joins(spark):
    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.randrange(50), i) for i in range(60)]
    right = [(rng.choice("ab"), rng.randrange(50), i) for i in range(25)]
    l, r = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v long")
    got = {x["i"]: x["asof"] for x in relate.asof_join(l, r, "k", "t", "v", tie="v").collect()}
    for k, t, i in left:
        before = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        assert got[i] == (max(before)[1] if before else None)
    points, ranges = spark.range(40).withColumnRenamed("id", "p"), spark.createDataFrame([(0, 5), (3, 30), (39, 39), (7, 6)], "low long, high long")
    pairs = {(x["p"], x["low"]) for x in relate.between_join(points, ranges, "p", "low", "high", 4).collect()}
    assert pairs == {(p, lo) for p in range(40) for lo, hi in [(0, 5), (3, 30), (39, 39)] if lo <= p <= hi}


def test_difference_counts_the_rest(spark):
    a, b = (spark.createDataFrame([(f"l{i:02d}",) for i in x], "line string") for x in (range(20), range(15, 40)))
    got = [(r["line"], r["side"]) for r in relate.difference(a, b, ("a", "b"), 10).collect()]
    assert len(got) == 11 and ("... 25 more", "") in got and ("l00", "a") in got


def test_stream_equals_batch_for_any_split(spark, tmp_path):
    _, log = made(spark, 5)
    want = sorted(map(tuple, changelog.summary(log).collect()))
    for n in (1, 4):
        folder = str(tmp_path / f"in{n}")
        log.repartition(n).write.parquet(folder)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        run_available(running_summary(stream), f"summary{n}", str(tmp_path / f"cp{n}"))
        assert sorted(map(tuple, spark.table(f"summary{n}").collect())) == want
    run_available(windowed_counts(stream, delay="30 days"), "counts", str(tmp_path / "cpw"))
    assert sum(r["n"] for r in spark.table("counts").collect()) == 300
    log.write.mode("append").parquet(folder)
    twice = spark.readStream.schema(log.schema).parquet(folder)
    run_available(deduplicated(twice, delay="30 days"), "once", str(tmp_path / "cpd"), "append")
    assert spark.table("once").count() == 300
