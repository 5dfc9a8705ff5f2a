"""Streams of object states against the fold of all changes, for several splits into files, late rows, corrections and restarts."""

import datetime
import random

import pytest

from palimpsest.streaming import states

SCHEMA = "key string, seq timestamp, idx long, rev long, op string, attr string"


def by_hand(changes):
    """The states of changes(key, seq, idx, rev, op, attr), one after the other."""
    best = {}
    for key, seq, idx, rev, op, attr in changes:
        if key is None or seq is None or idx is None:
            continue
        rev = rev or 0
        if (key, seq, idx) not in best or best[key, seq, idx][0] < rev:
            best[key, seq, idx] = (rev, op, attr)
    out = {}
    for (key, _, idx), (_, op, attr) in sorted(best.items(), key=lambda x: x[0]):
        s = out.setdefault(key, {"last": None, "made": None, "n": 0, "attrs": {}})
        s["last"] = op
        if op == "DROP":
            s.update(made=None, n=0, attrs={})
            continue
        s["n"] += 1
        if op == "CREATE":
            s["made"] = idx
        elif op == "ALTER" and attr is not None:
            s["attrs"][attr] = idx
    return {k: (s["last"], s["made"], s["n"], sorted(s["attrs"].items())) for k, s in out.items()}


def random_changes(rng, n):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        seq = start + datetime.timedelta(hours=i // 2)
        row = (f"k{rng.randrange(5)}", seq, i, 0, rng.choice(["CREATE", "ALTER", "ALTER", "INSERT", "DROP"]), rng.choice(["a", "b", None]))
        rows.append(row)
        if rng.random() < 0.2:
            rows.append((*row[:3], 1, rng.choice(["CREATE", "ALTER", "DROP"]), rng.choice(["a", "b"])))
        if rng.random() < 0.1:
            rows.append(row)
    return rows


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_fold_with_late_corrected_rows_and_restart(spark, tmp_path, files):
    rng = random.Random(files)
    rows = [*random_changes(rng, 60), (None, datetime.datetime(2024, 1, 1), 1, 0, "DROP", None), ("k0", None, 5, 0, "DROP", None), ("k9", datetime.datetime(2024, 1, 1), 7, None, "ALTER", None)]
    rng.shuffle(rows)
    parts = [rows[i::files] for i in range(files)]
    told, place = str(tmp_path / "told"), str(tmp_path / "log")
    seen = []
    for part in parts:  # each part is a run of its own, which goes on from the state of the last
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(place)
        states.run_into(states.object_states(stream, horizon_ms=10**12), told, str(tmp_path / "cp"))
        seen += part
        got = {r["key"]: (r["last_op"], r["made_idx"], r["n_live"], [tuple(a) for a in r["attributes"]]) for r in states.latest(spark.read.parquet(told)).collect()}
        assert got == by_hand(seen)


def test_history_before_a_drop_is_forgotten_and_late_rows_change_nothing(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    told, place = str(tmp_path / "told"), str(tmp_path / "log")
    runs = [
        [("a", at(0), 1, 0, "CREATE", None), ("a", at(1), 2, 0, "ALTER", "x"), ("a", at(2), 3, 0, "DROP", None), ("a", at(3), 4, 0, "CREATE", None)],
        [("b", at(500), 9, 0, "CREATE", None)],
        [("b", at(501), 10, 0, "ALTER", "y")],
        [("a", at(1), 5, 0, "ALTER", "z"), ("a", at(4), 6, 0, "ALTER", "w")],
    ]
    for run in runs:
        spark.createDataFrame(run, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(SCHEMA).parquet(place)
        states.run_into(states.object_states(stream, horizon_ms=0), told, str(tmp_path / "cp"))
    got = {r["key"]: (r["last_op"], r["made_idx"], r["n_live"], [tuple(x) for x in r["attributes"]]) for r in states.latest(spark.read.parquet(told)).collect()}
    assert got == by_hand([c for run in runs for c in run])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.PROVIDER)
    kept = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "history").load()
    assert sorted(r["k"] for r in kept.selectExpr("user_map_key.idx as k", "key.key as o").where("o = 'a'").collect()) == [3, 4, 6]
