"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from fixtures import prose, slow_apportionment
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bit_planes, bpe, common, exact_dedup, language_id, licenses, line_rules, mixing, near_dedup, pseudonyms, warc

#: Names that operators use inside, and one with a dot.
CLASHING = [
    "row", "id", "digest", "may", "gone", "c_id", "key", "rep", "label", "run", "n", "size", "taken", "parts", "t", "take", "no", "cut",
    "line", "host", "text_hash", "__t", "__text", "__id", "__size", "__page", "kept", "keep_id", "score", "lang_pred", "held_out",
    "class_id", "component_id", "text_digest", "payload", "offset", "a.b", "Row Two",
]
LONG = prose(random.Random(1), 40_000)
CARD = "pay 4111111111111111 now, or mail a.b@example.org"


def rows():
    rng = random.Random(6)
    same = prose(rng, 60)
    texts = [(1, same), (2, same), (2, same), (3, None), (3, None), (None, same), (None, None), (4, ""), (5, "  \n\t "), (6, LONG), (7, "12 34 !?")]
    texts += [(8, CARD), (8, CARD), (9, same.upper()), (10, "one two")] + [(20 + i, prose(rng, 25)) for i in range(12)]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in texts]


def clashing(spark, own):
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat_ws(":", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "line_rules": lambda d: line_rules.line_frequency_rules(d),
    "near_groups": lambda d: near_dedup.near_groups(d),
    "license_scan": lambda d: licenses.license_scan(d, licenses.known_licenses(d.sparkSession, licenses.KNOWN)),
    "mix": lambda d: mixing.mix(d, block=4, shard_words=300),
    "pseudonymised": lambda d: pseudonyms.pseudonymised(d, "k"),
    "plane_round_trip": lambda d: bit_planes.plane_round_trip(d, WORDS),
    "encode_round_trip": lambda d: bpe.encode_round_trip(d, RANKS, public_tokenizers.PATTERN),
    "exact_groups": lambda d: exact_dedup.exact_groups(d),
    "warc_round_trip": lambda d: warc.warc_round_trip(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[f"`{c}`" for c in CLASHING])),
    "identify_languages": lambda d: language_id.identify_languages(d, PIECES, max_docs=20, rounds=1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_stand_odd_rows(spark, name):
    own = rows()
    got = OPERATORS[name](clashing(spark, own)).collect()
    # exact groups give one row for rows that repeat doc_id and text (and null text is the empty one)
    repeats = len({(i, (t or "").lower()) for i, t, *_ in own}) if name == "exact_groups" else len(own)
    assert len(got) == repeats
    key = "page_id" if name == "warc_round_trip" else "doc_id"
    assert {r[key] for r in got} == {r[0] for r in own}
    by = {}
    for r in got:  # rows that repeat doc_id and text have the same answer, but for places and shares
        by.setdefault(r[key], []).append(r)
    if name not in ("mix", "plane_round_trip", "exact_groups", "warc_round_trip"):
        assert by[2][0] == by[2][1] and by[8][0] == by[8][1] and by[3][0] == by[3][1]
    again = OPERATORS[name](clashing(spark, own).repartition(5)).collect()
    if name != "identify_languages":
        assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_stand_empty_tables(spark, name):
    assert OPERATORS[name](clashing(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "near_dedup", "mixing"])
def test_stages_keep_columns_of_any_name(spark, name):
    docs, stage = clashing(spark, rows()), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    before = {tuple(r[c] for c in docs.columns[5:]) for r in docs.collect()}
    got = out.collect()
    assert got and all(tuple(r[c] for c in out.columns[5:]) in before for r in got)
    assert all(r["a.b"] == ":".join(["a.b"] + [str(r["doc_id"])] * (r["doc_id"] is not None)) for r in got)
    assert stage(spark, docs.where("false"), "").count() == 0


def test_stage_results_on_odd_rows(spark):
    docs, stages = clashing(spark, rows()), dict(corpus_pipeline.STAGES)
    unique = sorted(str(r["doc_id"]) for r in stages["exact_dedup"](spark, docs, "").collect())
    assert unique == sorted(["9", "4", "5", "6", "7", "8", "10", *map(str, range(20, 32))])
    apart = [r["doc_id"] for r in stages["near_dedup"](spark, docs, "").collect()]
    # 1 stays of 1, 2, 2, 9 and null; rows without words, and without an id, stay
    assert sorted(map(str, apart)) == sorted(["1", "None", "None", "3", "3", "4", "5", "6", "7", "8", "8", "10", *map(str, range(20, 32))])


def test_pipeline_on_odd_rows(spark, tmp_path):
    clashing(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["n_tokens"] == len(r["ids"]) > 0 for r in got)


def test_long_words_teach_and_score():
    """Beyond the old limits: pieces of over 12 and words of over 48 characters, and of several stretches."""
    pieces = ["▁", "a", "b", "abababababababab", "ba"]
    lattice = language_id.Lattice(pieces)
    assert lattice.longest == 16
    p = np.array([0.2, 0.3, 0.2, 0.1, 0.1, 0.0, language_id.FLOOR])
    lengths = np.array([len(x) for x in pieces] + [0, 1])
    for word in ("▁" + "ab" * 40, "▁" + "x" * 60, "▁" + "ab" * 700 + "x" * 30, "▁" + "x" * 2500):
        counts = language_id.expected_counts([word, word], np.array([1.0, 2.0]), lattice, p)
        assert (counts * lengths).sum() == pytest.approx(3 * len(word), rel=1e-6)
    # forward sums by hand, in logs
    word, log = "▁" + "ab" * 30, {0: 0.0}
    value = dict(zip(pieces, p[:5], strict=True))
    for end in range(1, len(word) + 1):
        terms = [log[end - k] + math.log(value[x]) for k in range(1, 17) if end >= k and (x := word[end - k : end]) in value]
        log[end] = np.logaddexp.reduce(terms) if terms else -1e300
    assert language_id.log_scores([word], lattice, p[:, None])[0, 0] == pytest.approx(log[len(word)])


@pytest.mark.parametrize("kind", ["shares", "ties", "capped", "one large"])
def test_apportionment_of_many_parties_is_flat(spark, kind):
    """Quotas are those of highest quotients over all parties of an owner, however many they are."""
    rng = random.Random(kind)
    parties, seats = [], {}
    for owner in range(4):
        n = rng.choice([1, 40, 300])
        votes = [{"shares": rng.randint(0, 900), "ties": rng.choice([5, 5, 5, 10]), "capped": rng.randint(1, 60), "one large": 1 if i else 40_000}[kind] for i in range(n)]
        caps = [rng.randint(0, 6) if kind == "capped" else 1000 for _ in votes]
        parties += [(owner, i, float(v), c) for i, (v, c) in enumerate(zip(votes, caps))]
        seats[owner] = rng.randint(0, 2 * n + 5)
    leaves = spark.createDataFrame(parties, "owner long, no long, votes double, cap long")
    got = {(r["owner"], r["no"]): r["quota"] for r in mixing.dealt(leaves, spark.createDataFrame(list(seats.items()), "owner long, quota long")).collect()}
    for owner, n in seats.items():
        own = [p for p in parties if p[0] == owner]
        assert [got[owner, p[1]] for p in own] == slow_apportionment([int(p[2]) for p in own], n, [p[3] for p in own])


def test_numbers_within_keys(spark):
    own = [(k, v, i) for i, (k, v) in enumerate([("a", 3), ("b", None), ("a", 1), (None, 7), ("a", 3), (None, 2), ("b", 5)] * 9)]
    df = spark.createDataFrame(own, "k string, v long, i long").repartition(5)
    for keys in (["k"], []):
        got = common.numbered(df, keys, [F.col("v").asc_nulls_last(), F.col("i")], "no").collect()
        for k in {r["k"] for r in got} if keys else {0}:
            mine = sorted((r for r in got if not keys or r["k"] == k), key=lambda r: (r["v"] is None, r["v"] or 0, r["i"]))
            assert [r["no"] for r in mine] == list(range(1, len(mine) + 1))
    assert common.numbered(df.limit(0), [], [F.col("v")], "no").count() == 0


def test_sieve_marks_every_member(spark):
    own = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    members = own.where("k % 10 = 0 or k % 10 = 3").select("v").distinct()
    marked = common.sieved(own, F.col("v"), members, F.col("v"), "may")
    missed = marked.where("not may and (v is null or k % 10 = 3)").count()
    assert missed == 0 and marked.where("may and v is not null and k % 10 != 3").count() < 50


def test_copies_count(spark):
    """Documents of equal text count each, or once, as a named parameter says."""
    line = " ".join(f"word{i}" for i in range(12))
    own = [(i, f"{line}\n{prose(random.Random(2), 30)}", None, "h", 0) for i in range(6)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["n_removed_lines"] for r in line_rules.line_frequency_rules(docs, min_docs=3).collect()} == {2}
    assert {r["n_removed_lines"] for r in line_rules.line_frequency_rules(docs, min_docs=3, copies_once=True).collect()} == {0}


def test_new_formats_of_personal_data(spark):
    texts = ["12/25/2001 12/25/2001", "02/30/2001", "13/25/2001", "000-000-0000", "743-111-2222 743-011-2222", "(017) 555-7713", "John.SMITH9@Example.org"]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(own, "k").collect()}
    a, b = got[0]["text"].split(" ")
    assert a == b != "12/25/2001" and int(a[3:5]) > 12 and int(a[:2]) <= 12
    assert all(got[i]["text"] == texts[i] for i in (1, 2, 3, 4))
    area, exchange, line = got[5]["text"][1:4], got[5]["text"][6:9], got[5]["text"][10:]
    assert got[5]["n_phone"] == 1 and got[5]["text"] != texts[5] and area != "000" and exchange >= "200" and exchange[1:] != "11" and len(line) == 4
    local, domain = got[6]["text"].split("@")
    assert domain == "Example.org" and local[4] == "." and len(local) == 11
    capitals = [c.isupper() or c.isdigit() for c, o in zip(local, "John.SMITH9") if o.isupper()]
    assert all(capitals) and not any(c.isupper() for c, o in zip(local, "John.SMITH9") if not o.isupper())


def test_permutations_of_new_formats_are_one_to_one(spark):
    phones = spark.range(0, 999 * 792, 97).select(
        F.format_string("%03d-%s-0001", F.floor(F.col("id") / 792) + 1, (200 + 100 * F.floor(F.col("id") % 792 / 99) + F.col("id") % 99 + F.when(F.col("id") % 99 >= 11, 1).otherwise(0)).cast("string")).alias("p")
    )
    made = phones.select(pseudonyms.phone_pseudonym(F.col("p"), F.lit("k")).alias("x"), "p")
    assert made.select("x").distinct().count() == phones.count() and made.where(f"not x rlike '{pseudonyms.PHONE.replace(chr(92), chr(92) * 2)}'").count() == 0
    days = spark.range(0, 146097, 5).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d")).where("dayofmonth(d) > 12")
    moved = days.select(pseudonyms.month_first_pseudonym(F.date_format("d", "MM/dd/yyyy"), F.lit("k")).alias("x"))
    assert moved.distinct().count() == days.count() and moved.where("cast(substring(x, 4, 2) as int) <= 12").count() == 0


def test_characters_of_other_versions_of_unicode():
    import tiktoken

    encoder = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    odd = [chr(c) for c in (0x18DA7, 0x2CEA7, 0x1E6E7, 0x323B0, 0x11DE0, 0x10EC2, 0x85, 0x1C, 0x2028, 0x378)]
    texts = [f"a{c}a {c}{c} 1{c} !{c}{c} b" for c in odd] + ["".join(odd)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()
    assert not bpe.Splitter(r"\p{L}+ \p{L}+|.").by_spaces
    whole = bpe.BytePairEncoder(bpe.load_ranks(RANKS), r"\p{L}+ \p{L}+|[\s\S]")
    assert [whole.decode(x) for x in whole.encode(["ab cd ef", "x y"])] == [b"ab cd ef", b"x y"]


def test_other_tokenizers_are_refused(tmp_path):
    import json

    found = json.load(open(WORDS))
    found["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(found))
    with pytest.raises(ValueError):
        bit_planes.WordTokenizer(str(tmp_path / "other.json"))
