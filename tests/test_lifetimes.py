"""Lives, cascades, one build order and rights against brute force, and what compact() makes of them."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import graph, lifetimes, privileges
from palimpsest.plans import compact as c


def lives_by_hand(changes):
    out, by = [], {}
    for node, at, op in sorted(set(changes), key=lambda x: (x[1], x[2] == "CREATE")):
        if op in ("CREATE", "DROP"):
            by.setdefault(node, {})[at] = op if by.get(node, {}).get(at) != "CREATE" else "CREATE"
    for node, ops in by.items():
        times = sorted(ops)
        out += [(node, t, times[i + 1] if i + 1 < len(times) else None) for i, t in enumerate(times) if ops[t] == "CREATE"]
    return out


def test_lives_and_cascades_are_the_brute_force(spark):
    rng = random.Random(4)
    for n in (4, 12):
        changes = [(f"n{rng.randrange(n)}", t, rng.choice(["CREATE", "CREATE", "DROP", "ALTER"])) for t in range(60)] + [("n0", 7, "CREATE"), (None, 3, "CREATE")]
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", t) for t in range(1, 60, 2)] + [("n1", None, 5), ("nowhere", "n1", 5)]
        drops = [(f"n{rng.randrange(n)}", t) for t in range(2, 60, 5)]
        alive = lifetimes.lives(spark.createDataFrame(changes, "node string, at long, op string"))
        lived = lives_by_hand([x for x in changes if x[0]])
        assert sorted(map(tuple, alive.collect()), key=str) == sorted(lived, key=str)
        holding = lifetimes.held(spark.createDataFrame(edges, "src string, dst string, since long"), alive)
        hold = {(s, m, d, t, e) for s, d, t in edges if d for node, m, e in lived if node == s and m <= t and (e is None or t < e)}
        assert set(map(tuple, holding.collect())) == hold
        taken, new = set(), set(drops)
        while new:
            reached = {((s, m), at) for at_node, at in new for s, m, d, t, e in hold if d == at_node and t < at and (e is None or at < e)} - taken
            taken |= reached
            new = {(s, at) for (s, _), at in reached}
        want = {}
        for life, at in taken:
            want[life] = min(at, want.get(life, at))
        got = lifetimes.cascades(holding, spark.createDataFrame(drops, "node string, at long")).collect()
        assert {(r["node"], r["made"]): r["at"] for r in got} == want
    assert lifetimes.cascades(holding, spark.createDataFrame([], "node string, at long")).count() == 0


def test_one_order_keeps_all_edges(spark):
    rng = random.Random(9)
    nodes = [(f"n{i}", rng.randrange(4)) for i in range(40)]
    edges = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(50))] + [("n1", "gone"), ("n2", "n2")]
    edges += [("n1", "n2"), ("n2", "n3"), ("n3", "n1")]
    placed = {r["node"]: r for r in graph.phased_order(spark.createDataFrame(nodes, "node string, phase int"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert set(placed) == {n for n, _ in nodes}
    near = {a: {b for x, b in edges if x == a and b in placed and b != a} for a in placed}
    reach = {a: set(near[a]) for a in placed}
    for _ in placed:
        reach = {a: reach[a] | {y for b in reach[a] for y in reach[b]} for a in placed}
    own = dict(nodes)
    for a, r in placed.items():
        assert r["cyclic"] == (a in reach[a])
        part = {a} | {b for b in reach[a] if a in reach[b]}
        above = {x for x in placed if x in part or part & reach[x]}
        assert r["phase"] == min(own[x] for x in above)
        for b in near[a] - part:
            assert (placed[b]["phase"], placed[b]["level"]) < (r["phase"], r["level"])


def test_deep_chains_and_long_cycles_have_no_cap(spark):
    ring = spark.range(80).selectExpr("cast(id as string) as src", "cast((id + 1) % 80 as string) as dst")
    assert len(graph.cycle_paths(ring).first()["path"]) == 81


def rights_by_hand(changes):
    """One change after the other, what a grantor has granted falling with its option."""
    held, option = set(), set()

    def settle():
        while True:
            # a cell stands on its grantor's option, from whomever that is
            roles = {(k[:4], k[4]) for k in option}
            bad = {k for k in option | held if k[5] and (k[:4], k[5]) not in roles}
            if not bad:
                return
            option.difference_update(bad)
            held.difference_update(bad)

    for o, kind, col, privilege, grantee, grantor, _, op, opt in sorted(changes, key=lambda x: x[6]):
        every = privileges.ALL_OF[kind].split() if privilege == "ALL" else [privilege]
        for p in every:
            k = (o, kind, col, p, grantee, grantor)
            if op == "GRANT":
                if grantor and (k[:4], grantor) not in {(x[:4], x[4]) for x in option}:
                    continue
                held.add(k)
                option.update({k} if opt else set())
            else:
                option.discard(k)
                if not opt:
                    held.discard(k)
        settle()
    return {(*k, k in option) for k in held}


def test_rights_are_the_brute_force(spark):
    rng = random.Random(3)
    for seed in range(3):
        changes = []
        for t in range(120):
            grantee = rng.choice("abcde")
            grantor = rng.choice(["", "", *[x for x in "abcde" if x < grantee]])  # along an order, so no circle of grants
            changes.append((rng.choice(["s1", "s2"]), "SCHEMA", "", rng.choice(["ALL", "CREATE", "USAGE"]), grantee, grantor, t, rng.choice(["GRANT", "GRANT", "REVOKE"]), rng.random() < 0.5))
        df = spark.createDataFrame(changes, "object string, kind string, col string, privilege string, grantee string, grantor string, at long, op string, option boolean")
        got = {tuple(r) for r in privileges.held_in_the_end(df).collect()}
        assert got == rights_by_hand(changes), seed
    assert privileges.held_in_the_end(df.limit(0)).count() == 0


def built(spark, *texts):
    scripts = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "seq long, content string")
    return [r["sql"] for r in c.compact(scripts).orderBy("position").collect()]


def test_cascades_in_scripts(spark):
    got = built(
        spark,
        "CREATE TABLE a (id int PRIMARY KEY); CREATE TABLE b (id int, a int REFERENCES a(id) ON DELETE CASCADE, CONSTRAINT f FOREIGN KEY (a) REFERENCES public.a(id));"
        "CREATE VIEW v AS SELECT * FROM a; CREATE VIEW w AS SELECT * FROM v; DROP TABLE a CASCADE;"
        "CREATE SCHEMA s; CREATE TABLE s.t (id int); CREATE FUNCTION s.f() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql; CREATE TABLE k (id int DEFAULT s.f(), z int); CREATE INDEX i ON s.t (id); DROP SCHEMA s CASCADE;"
        "CREATE TYPE e AS ENUM ('a'); CREATE DOMAIN d AS e; CREATE TABLE y (x e, y int, z d); DROP TYPE e CASCADE",
        "CREATE TABLE r (a int); CREATE INDEX ri ON r (a); CREATE VIEW rv AS SELECT a FROM r; DROP TABLE r CASCADE; CREATE TABLE r (a int); CREATE VIEW ru AS SELECT a FROM r;"
        "CREATE TABLE p (a int); CREATE POLICY q ON p USING (true); CREATE POLICY q ON r USING (false); CREATE TRIGGER g AFTER INSERT ON p EXECUTE FUNCTION x(); CREATE TRIGGER g AFTER INSERT ON r EXECUTE FUNCTION x(); DROP TRIGGER g ON r;"
        "CREATE TABLE public.u (a int); ALTER TABLE u ADD b int; CREATE INDEX ui ON u (a); DROP INDEX public.ui; ALTER TABLE u ALTER COLUMN b ADD GENERATED ALWAYS AS IDENTITY; ALTER TABLE public.u DROP COLUMN b",
    )
    assert got == [
        "CREATE TABLE b (id int, a int)", "CREATE TABLE k (id int, z int)", "CREATE TABLE p (a int)", "CREATE TABLE r (a int)", "CREATE TABLE u (a int)", "CREATE TABLE y (y int)",
        "CREATE TRIGGER g AFTER INSERT ON p EXECUTE FUNCTION x()", "CREATE VIEW ru AS SELECT a FROM r",
        "CREATE POLICY q ON p USING (true)", "CREATE POLICY q ON r USING (false)",
    ]


def test_order_data_and_rights_in_scripts(spark):
    got = built(
        spark,
        "CREATE TABLE t (i int DEFAULT f()); CREATE FUNCTION f() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql; CREATE INDEX mi ON m (i); CREATE MATERIALIZED VIEW m AS SELECT i FROM t;"
        "CREATE TABLE a1 PARTITION OF z FOR VALUES FROM (1) TO (2); CREATE TABLE z (i int) PARTITION BY RANGE (i); CREATE TABLE b1 (j int) INHERITS (zz); CREATE TABLE zz (k int);"
        "CREATE TABLE d (a int, z int); ALTER TABLE d ADD q int; INSERT INTO d(a) VALUES (1); ALTER TABLE d RENAME a TO b; INSERT INTO d(b) VALUES (2); COMMENT ON COLUMN d.z IS 'gone'; ALTER TABLE d DROP COLUMN z;"
        "CREATE TABLE u (x int); COMMENT ON COLUMN u.x IS 'first'; ALTER TABLE u RENAME x TO k; INSERT INTO u VALUES (1)",
        "REVOKE ALL ON t FROM PUBLIC; GRANT SELECT ON TABLE t TO u WITH GRANT OPTION; GRANT SELECT (a, b), INSERT (a) ON d TO v; GRANT ALL ON t TO w; REVOKE INSERT ON t FROM w; GRANT ALL PRIVILEGES ON public.t TO x;"
        "GRANT SELECT ON u, zz TO u, v; REVOKE SELECT ON u FROM v; GRANT SELECT ON zz TO m WITH GRANT OPTION; GRANT SELECT ON zz TO n GRANTED BY m; REVOKE SELECT ON zz FROM m CASCADE; GRANT UPDATE ON zz TO u WITH GRANT OPTION;"
        "REVOKE GRANT OPTION FOR UPDATE ON zz FROM u; GRANT EXECUTE ON FUNCTION f(), g(int, text) TO u; REVOKE EXECUTE ON FUNCTION f() FROM PUBLIC; CREATE TABLE h (i int); GRANT SELECT ON h TO u; DROP TABLE h; CREATE TABLE h (i int)",
    )
    assert got == [
        "CREATE TABLE d (a int, z int, q int)", "INSERT INTO d(a) VALUES (1)", "ALTER TABLE d RENAME a TO b", "INSERT INTO d(b) VALUES (2)", "ALTER TABLE d DROP COLUMN z",
        "CREATE TABLE h (i int)", "CREATE TABLE u (k int)", "CREATE TABLE z (i int) PARTITION BY RANGE (i)", "CREATE TABLE zz (k int)", "CREATE FUNCTION f() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql",
        "CREATE TABLE a1 PARTITION OF z FOR VALUES FROM (1) TO (2)", "CREATE TABLE b1 (j int) INHERITS (zz)", "CREATE TABLE t (i int DEFAULT f())",
        "CREATE MATERIALIZED VIEW m AS SELECT i FROM t", "CREATE INDEX mi ON m (i)",
        "REVOKE EXECUTE ON FUNCTION f() FROM PUBLIC", "GRANT EXECUTE ON FUNCTION f() TO u", "GRANT EXECUTE ON FUNCTION g(int, text) TO u", "GRANT INSERT (a), SELECT (a, b) ON d TO v",
        "REVOKE ALL ON t FROM PUBLIC", "GRANT SELECT ON t TO u WITH GRANT OPTION", "GRANT DELETE, REFERENCES, SELECT, TRIGGER, TRUNCATE, UPDATE ON t TO w", "GRANT ALL ON t TO x",
        "GRANT SELECT ON u TO u", "GRANT SELECT, UPDATE ON zz TO u", "GRANT SELECT ON zz TO v",
        "COMMENT ON COLUMN u.k IS 'first'", "INSERT INTO u VALUES (1)",
    ]


def reach_by_hand(edges, seeds):
    depth, near = {s: 0 for s in seeds}, set(seeds)
    while near:
        near = {b for a, b in edges if a in near and b not in depth}
        depth |= {b: 1 + min(depth[a] for a, x in edges if x == b and a in depth) for b in near}
    return {(b, d, min((a for a, x in edges if x == b and a != b and depth.get(a) == d - 1), default=None)) for b, d in depth.items()}


def test_reach_is_kept_up_with_changes(spark):
    rng = random.Random(8)
    for n, m in ((12, 16), (40, 60)):
        pick = lambda k, n=n: {(rng.randrange(n), rng.randrange(n)) for _ in range(k)}
        edges = pick(m)
        seeds, added = {0, 1}, pick(6)
        removed = set(rng.sample(sorted(edges), m // 3)) | {(99, 98)}
        df = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
        start = spark.createDataFrame([(s,) for s in seeds], "node long")
        reached = graph.cut(graph.reached_from(df(edges), start))
        own = {(a, b) for a, b in edges if a != b}
        assert {tuple(r) for r in reached.collect()} == reach_by_hand(own, seeds)
        after = {(a, b) for a, b in (own - (removed - added)) | added if a != b}
        assert {tuple(r) for r in graph.maintained(reached, df(edges), df(added), df(removed)).collect()} == reach_by_hand(after, seeds)
        ways = {}
        for r in graph.way_to(reached, spark.createDataFrame([(i,) for i in range(n)], "node long")).collect():
            ways.setdefault(r["node"], {})[r["depth"]] = r["step"]
        assert set(ways) == {node for node, *_ in reach_by_hand(own, seeds)}
        for node, way in ways.items():
            steps = [way[i] for i in range(len(way))]
            assert steps[0] in seeds and steps[-1] == node and all(e in own for e in zip(steps, steps[1:]))
