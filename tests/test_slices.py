"""Windows over slices against plain Python, with a key that holds a third of all rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from palimpsest.operators import batches, changelog, relate, slices

OPS = ["CREATE", "ALTER", "DROP", "INSERT"]


def log(spark, n=3000):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(40)}", rng.randrange(500), i, rng.choice(OPS), f"a{i % 4}", float(i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, seq long, idx long, op string, attr string, value double").repartition(5)


def by_key(rows):
    own = defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in own.items()}


def test_slices_hold_about_as_many_rows(spark):
    _, own = log(spark)
    sizes = [r["count"] for r in slices.sliced(own, "seq", 16).groupBy(slices.SLICE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 3000 / 16
    assert slices.sliced(own, "attr").select(slices.SLICE).distinct().count() == 1
    assert slices.sliced(own.where("false"), "seq").count() == 0


def test_neighbours_and_carried_values(spark):
    rows, own = log(spark)
    want, firsts, priors, numbers, alive = {}, set(), {}, {}, set()
    for key, events in by_key(rows).items():
        last, batch, alone, dropped = None, 0, True, max([i for i, r in enumerate(events) if r[3] == "DROP"], default=-1)
        firsts.add(events[0][2])
        for i, r in enumerate(events):
            want[r[2]] = events[i + 1][3] if i + 1 < len(events) else None
            priors[r[2]], last = last, r[2] if r[3] == "INSERT" else last
            batch += alone or r[3] == "INSERT"
            numbers[r[2]], alone = batch, r[3] == "INSERT"
            if i > dropped:
                alive.add((r[2], i))
    got = changelog.with_next(own).collect()
    assert {r["idx"]: r["next_op"] for r in got} == want and {r["idx"] for r in got if r["is_first"]} == firsts
    assert {r["idx"]: r["prior"] for r in relate.prior(own, "key", F.col("op") == "INSERT", "idx", "seq", "idx").collect()} == priors
    assert {r["idx"]: r["batch"] for r in batches.in_batches(own, "key", F.col("op") == "INSERT", "seq", "idx").collect()} == numbers
    assert {(r["idx"], r["n_before"]) for r in changelog.since_last_drop(own).collect()} == alive
    assert changelog.with_next(own).columns == own.columns + ["next_op", "is_first"]


def test_as_of_values(spark):
    rows, own = log(spark)
    left, right = own.where("op = 'DROP'").select("key", "seq", "idx"), own.where("op = 'CREATE'")
    got = {r["idx"]: r["asof"] for r in relate.asof_join(left, right, "key", "seq", "idx", tie="idx").collect()}
    for key, events in by_key(rows).items():
        for r in events:
            if r[3] == "DROP":
                made = [e[2] for e in events if e[3] == "CREATE" and e[1] <= r[1]]
                assert got[r[2]] == (made[-1] if made else None)
