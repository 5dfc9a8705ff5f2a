"""Fill-in-middle, the positional index and the conversation trie against brute force, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from fixtures import prose
from pyspark.sql import functions as F

from palimpsest.llm import contamination, conversation_trie, fill_in_middle

CLASHING = ["row", "id", "t", "n", "form", "doc", "txt", "word", "pos", "term", "items", "spans", "n_words", "__hit", "__page", "a.b", "same", "part", "p", "k1", "digest"]


def with_clashes(df, key):
    return df.select("*", *[F.concat_ws(":", F.lit(c), F.col(key).cast("string")).alias(c) for c in CLASHING])


# fill in the middle


def fim(doc_id, text):
    text, h = text or "", hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}", text
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}", text


def fim_rows():
    rng = random.Random(2)
    odd = [None, "", "x", "\n", "a<P>b", "<S>", "<M", "<<<>>>", "P><S", "é\U0001f600‍́z", "tab\tcr\r\nend\n", "\\n . ( [", prose(rng, 30_000)]
    rows = [(i, t) for i, t in enumerate(odd * 6)] + [(None, "no id"), (None, None), (7, "again"), (7, "again"), (-3, "minus")]
    return rows + [(1000 + i, "".join(rng.choice("<>PSMaé\U0001f600\n ") for _ in range(rng.randint(0, 40)))) for i in range(300)]


def test_fill_in_middle_is_the_brute_force(spark):
    rows = fim_rows()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id")
    made = fill_in_middle.fill_in_middle(docs)
    got = sorted((str(r.row["doc_id"]), r.row["a.b"], r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made.collect())
    own = [(str(i), "a.b" if i is None else f"a.b:{i}", *fim(i, t)) for i, t in rows]
    assert [tuple(map(str, r)) for r in got] == sorted(tuple(map(str, r)) for r in own)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert made.where("false").count() == 0 and fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_texts_longer_than_a_slice_are_cut_whole(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "SLICE_BYTES", 50)
    rows = [(i, prose(random.Random(i), 30)) for i in range(40)]
    made = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.row.doc_id, r.output) for r in made.collect()) == [(i, fim(i, t)[4]) for i, t in rows]


def test_marks_and_shares_are_parameters(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(200)], "doc_id long, text string")
    made = fill_in_middle.fill_in_middle(docs, fim_percent=100, spm_percent=100, marks=("<x>", "<y>", "<z>"))
    assert all(r.form == "spm" and r.output.startswith("<y>") and r.restored == "some text" for r in made.collect())
    with pytest.raises(ValueError, match="marks"):
        fill_in_middle.fill_in_middle(docs, marks=("<P>", "<P>", "<M>"))


# positional index


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_contamination(docs, items, size, near):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size + 1, 1)) if w else ():
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found, close = set(), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= of
            if any(set(win) <= set(w[k : k + near]) for k in range(len(w))):
                close |= of
        out.append((i, len(w), len(hit), sorted(found), sorted(close)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "near"), [(10, 15), (3, 3)])
def test_contamination_is_the_brute_force(spark, size, near):
    rng = random.Random(size)
    vocabulary = ["aa", "bb", "Cc", "dd", "ÉÉ", "éé", "the", "x1", "语", "r"]
    phrase = lambda n, v=vocabulary: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, phrase(rng.randint(1, 30), vocabulary + [f"w{i}{j}" for j in range(12)])) for i in range(25)]
    items += [(3, "another text of item three with ten words or more here"), (90, None), (91, ""), (92, "... !"), (None, phrase(12)), (93, "the the the the the the the the the the"), (94, "r")]
    items += [(95, items[0][1]), (10, items[1][1])]  # windows that items share; ids that sort as strings
    docs = [(i, phrase(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{phrase(5)}, {rng.choice(items)[1]} {phrase(7)}") for i in range(30)]
    docs += [(200 + i, " ".join(rng.sample(words(items[i][1]), len(words(items[i][1]))))) for i in range(10)]  # other order
    docs += [(300, None), (301, ""), (302, "?!"), (None, items[2][1]), (None, items[2][1]), (None, None), (5, items[4][1]), (5, items[5][1].upper()), (303, "The_the-THE the the the,the the the the the")]
    docs += [(304, " ".join([prose(rng, 20_000), items[6][1], prose(rng, 100)])), (304, " ".join([items[6][1]] * 30))]
    d = with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id")
    b = with_clashes(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    found = contamination.contaminated(d, b, size=size, near=near)
    got = sorted([(r.row["doc_id"], r.n_words, r.n_hit, r["items"], r.near_items) for r in found.collect()], key=str)
    want = brute_contamination([x for x in docs if x[0] != 304], items, size, near)
    assert [g for g in got if g[0] != 304] == want
    assert all(g[2] >= len(words(items[6][1])) for g in got if g[0] == 304) and any(w[2] for w in want)
    for r in found.where("n_hit > 0").collect():
        assert all(a.to < b.__getattr__("from") for a, b in zip(r.spans, r.spans[1:])) and sum(s.to - s["from"] for s in r.spans) == r.n_hit


def test_contamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in contamination.contaminated(d, b.limit(0)).collect()] == [(0, [])]
    assert contamination.contaminated(d.limit(0), b).count() == 0
    assert [(r.n_hit, r["items"]) for r in contamination.contaminated(d, b).collect()] == [(1, ["1"])]


# conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = (turns.get(c - c % 100, [])[:h]) + t[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    below = defaultdict(set)
    for k in members:
        if k:
            below[k[:-1]].add(k)
    sums = defaultdict(lambda: [0, 0])
    for k, m in members.items():
        saved = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            sums[k[:d]][0] += not below[k]
            sums[k[:d]][1] += saved
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(250, 260), 505, 777]:
        for t in range(rng.choice([1, 1, 2, 3, 7, 12])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "\U0001f600"])))
    rows += [(41, t, "user", f"deep {t % 3}") for t in range(90)] + [(42, t, "user", f"deep {t % 3}") for t in range(70)]
    rows += [(c, 0, "user", "same") for c in range(600, 660)] + [(c, 1, "bot", "same") for c in range(600, 650)]
    rows += [(43, None, "user", "first"), (43, 5, "x", "tie"), (43, 5, "x", "eit"), (43, 5, "x", "tie"), (43, None, "u", "nul"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [4, 65536])
def test_trie_is_the_brute_force(spark, span):
    rows = trie_rows()
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), "conv_id")
    got = conversation_trie.prefix_trie(conversation_trie.rebuilt_conversations(df), span=span)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(conversation_trie.rebuilt_conversations(df)).count() == 0


def test_subtree_sums_of_a_chain_take_few_rounds(spark):
    n = 300
    chain = spark.range(n).selectExpr("id as depth", "id as k1", "id as k2", "if(id = 0, null, id - 1) as u1", "if(id = 0, null, id - 1) as u2", "cast(1 as long) as v")
    got = {r.depth: r.v for r in conversation_trie.subtree_sums(chain, ["v"]).collect()}
    assert got == {d: n - d for d in range(n)}
