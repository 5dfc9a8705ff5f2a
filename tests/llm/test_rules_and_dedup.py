import hashlib
import re
from collections import Counter, defaultdict

from fixtures import DOC, documents, edited, prose, spark_documents
import random

from palimpsest.llm import near_dedup, shingles
from palimpsest.llm.components import components
from palimpsest.llm.exact_dedup import drop_exact_copies, exact_groups
from palimpsest.llm.line_rules import line_frequency_rules, remove_lines
from palimpsest.llm.near_dedup import drop_near_copies, near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def as_dict(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def measures(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_line_rules_against_brute_force(spark):
    rows = documents()
    got = as_dict(line_frequency_rules(spark_documents(spark), min_docs=3, max_share=0.0))
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    seen = defaultdict(set)
    for _, text, _, host, *_ in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                seen[host, norm(line)].add(text)
    assert len(got) == len(rows)
    for i, text, _, host, *_ in rows:
        r = got[i]
        m = measures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        lines = [norm(x) for x in (text or "").split("\n") if norm(x)]
        gone = [x for x in lines if len(seen[host, x]) > 3]
        assert r["n_removed_lines"] == len(gone)
        depleted = sum(map(len, lines)) - sum(map(len, gone)) < 0.5 * sum(map(len, lines))
        assert r["kept"] == (not r["base_failed"] and not depleted)
    assert any(r["n_removed_lines"] for r in got.values())


def test_depleted_documents_go_and_copies_count(spark):
    long_line = " ".join(f"word{i}" for i in range(20))
    rows = [(i, long_line + f"\nrest{i} only", "en", "h", 0, "") for i in range(5)]
    rows += [(10 + i, prose(random.Random(3), 30), "en", "h", 0, "") for i in range(5)]  # equal texts
    got = as_dict(line_frequency_rules(spark_documents(spark, rows), min_docs=3, max_share=0.0))
    assert not any(got[i]["kept"] for i in (*range(5), *range(10, 15)))
    once = as_dict(line_frequency_rules(spark_documents(spark, rows), min_docs=3, max_share=0.0, copies_once=True))
    assert not any(once[i]["kept"] for i in range(5)) and all(once[10 + i]["kept"] for i in range(5))
    cleaned = as_dict(remove_lines(spark_documents(spark, rows), min_docs=3, max_share=0.0, copies_once=True))
    assert cleaned[0]["text"] == "rest0 only" and cleaned[10]["text"] == rows[5][1]
    clash = spark_documents(spark, rows).selectExpr("*", "doc_id as `id`", "1 as `gone`", "2 as `row`", "3 as `__hash`", "4 as `hash`", "5 as `a.b`")
    cleaned = as_dict(remove_lines(clash, min_docs=3))
    assert cleaned[3]["text"] == "rest3 only" and cleaned[11]["text"] == "" and (cleaned[3]["gone"], cleaned[3]["a.b"]) == (1, 5)


def test_line_limit_does_not_grow_with_the_host(spark):
    lines = ["one line that many documents of the host hold"] * 11 + ["another line that too few of them hold"] * 10
    for others in (0, 20_000):
        rows = [(i, f"{x}\n{prose(random.Random(i), 30)}", "en", "h", 0, "") for i, x in enumerate(lines)]
        rows += [(100 + i, f"text {i}", "en", "h", 0, "") for i in range(others)]
        got = as_dict(line_frequency_rules(spark_documents(spark, rows)))
        assert [got[i]["n_removed_lines"] for i in range(21)] == [1] * 11 + [0] * 10


def test_line_rules_empty_table_and_null_ids(spark):
    assert line_frequency_rules(spark_documents(spark, [])).count() == 0
    rows = [(None, None, None, None, None, None), (None, prose(random.Random(1), 20), None, None, None, None)] * 2
    got = line_frequency_rules(spark_documents(spark, rows)).collect()
    assert len(got) == 4 and sorted(r["kept"] for r in got) == [False, False, True, True]


def test_exact_groups_against_brute_force(spark):
    rows = documents()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[low(text)].append(i)
    for rounds, fan_in in ((2, 8), (3, 2), (1, 4)):
        got = as_dict(exact_groups(spark_documents(spark), rounds=rounds, fan_in=fan_in))
        assert len(got) == len(rows)
        for text, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
                assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups_repeats_nulls_empty(spark):
    rows = [(1, "A b", None, None, 0, ""), (1, "A b", None, None, 0, ""), (2, "a B", None, None, 0, ""), (None, "a b", None, None, 0, ""), (None, "z", None, None, 0, "")]
    got = exact_groups(spark_documents(spark, rows)).collect()
    assert len(got) == 4
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    h = hashlib.sha256(b"a b").hexdigest()
    assert by[1, h]["n_rows"] == 2 and by[1, h]["group_size"] == 4 and not by[1, h]["kept"]
    assert by[2, h]["kept"] and not by[None, h]["kept"]
    z = by[None, hashlib.sha256(b"z").hexdigest()]
    assert z["kept"] and z["keep_id"] is None
    left = drop_exact_copies(spark_documents(spark, rows + [(7, "q", None, None, 0, "")] * 3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("2", "a B"), ("7", "q"), ("None", "z")]
    assert exact_groups(spark_documents(spark, [])).count() == 0


def sets_of(text):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(rows):
    sets = {i: sets_of(t) for i, t, *_ in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups_against_brute_force(spark):
    rows = documents()
    got = as_dict(near_groups(spark_documents(spark)))
    want = brute_components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    left = {r["doc_id"] for r in drop_near_copies(spark_documents(spark)).collect()}
    assert left == {i for i, (_, c) in want.items() if i == c}


def test_near_groups_search_across_components(spark):
    """A large family of borderline copies: many buckets hold several components, and blocks and parts are small."""
    rng = random.Random(5)
    base = prose(rng, 60)
    rows = [(i, edited(rng, base, rng.randint(2, 6)), "en", "s", 0, "") for i in range(150)]
    got = as_dict(near_groups(spark_documents(spark, rows), block=2))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows)


def test_near_groups_nulls_repeats_empty(spark):
    text = prose(random.Random(9), 30)
    rows = [(4, text, None, None, 0, ""), (4, text, None, None, 0, ""), (None, text, None, None, 0, ""), (9, text, None, None, 0, ""), (None, None, None, None, 0, "")]
    got = near_groups(spark_documents(spark, rows)).collect()
    assert len(got) == 5
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [
        ("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "4", False), ("None", "None", True),
    ]
    assert near_groups(spark_documents(spark, [])).count() == 0


def test_sketch_estimates_similarity():
    sk = shingles.Sketcher(51, 5, 1024)
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.6, 0.75, 0.9):
        n = 2000
        both = int(n * 2 * share / (1 + share))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n : 2 * n - both])))
        x, y = (sk.odd(sk.minima([s])).view(np.uint64) for s in (a, b))
        assert abs(sk.estimate(np.bitwise_count(x ^ y).sum()) - share) < 0.12


def test_components_on_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == got[1001] == 1000
