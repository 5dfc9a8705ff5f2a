"""The registered queries of the corpus operators, with SQL for those whose results SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bit_planes import plane_round_trip
from palimpsest.llm.bpe import encode_round_trip
from palimpsest.llm.common import table
from palimpsest.llm.contamination import contaminated
from palimpsest.llm.conversation_trie import prefix_trie, rebuilt_conversations
from palimpsest.llm.exact_dedup import exact_groups
from palimpsest.llm.fill_in_middle import fill_in_middle
from palimpsest.llm.language_id import identify_languages
from palimpsest.llm.licenses import EQUIVALENT, known_digests, known_licenses, license_scan
from palimpsest.llm.line_rules import line_frequency_rules
from palimpsest.llm.mixing import mix
from palimpsest.llm.near_dedup import near_groups
from palimpsest.llm.pseudonyms import pseudonymised
from palimpsest.llm.warc import warc_round_trip


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
l AS (
  SELECT doc_id, source, t, pos, trim(regexp_replace(lower(ls[pos]), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, t, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
f AS (
  SELECT source, line FROM l WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) > 10),
r AS (
  SELECT l.doc_id, count(*) AS n_removed_lines, sum(length(l.line)) AS removed_chars
  FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.doc_id),
c AS (SELECT doc_id, sum(length(line)) AS line_chars FROM l GROUP BY doc_id),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
spots AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win JOIN twice USING (doc_id, g)),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM spots GROUP BY doc_id),
dup AS (
  SELECT doc_id, len(x) - len(list_distinct(x)) AS n
  FROM (SELECT doc_id, list_filter(ls, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS x FROM d)),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(dup.n AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         c.line_chars, CAST(coalesce(r.n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
         CAST(coalesce(r.removed_chars, 0) AS BIGINT) AS removed_chars
  FROM d JOIN dup USING (doc_id) JOIN c USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT line_chars - removed_chars < 0.5 * line_chars AS kept,
       n_removed_lines, removed_chars
FROM m
"""


def op2_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT n.doc_id, n.n, min(n.doc_id) OVER (PARTITION BY k) AS class_id
  FROM n JOIN (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id) USING (doc_id)),
r AS (SELECT s.doc_id, g, c.n FROM s JOIN c ON s.doc_id = c.class_id AND s.doc_id = c.doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (
  SELECT DISTINCT class_id AS doc_id, class_id AS root FROM c
  UNION SELECT b.v, reach.root FROM reach JOIN b ON b.u = reach.doc_id),
k AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(k.component_id, d.doc_id) AS kept, coalesce(c.class_id, d.doc_id) AS class_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.doc_id = c.class_id
"""


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_licenses(spark), lines=True)


def _op3_sql() -> str:
    """The canonical form, as RE2 can state it: lines that only reserve all rights go, but other copyright statements stay, since
    their holders end by lookaround. So the SQL holds for texts without these; tests hold the statements against whole licences."""
    spelled = "t"
    for variant, usual in EQUIVALENT:
        spelled = rf"regexp_replace({spelled}, '\b{variant}\b', '{usual}', 'g')"
    known = ", ".join(f"('{d}', '{i}')" for d, i in known_digests().items())
    return rf"""
WITH k AS (SELECT * FROM (VALUES {known}) AS k(digest, license_id)),
c AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(lower(
    regexp_replace(coalesce(text, ''), '(?im)^[^\p{{L}}\p{{N}}\n]*all rights reserved[^\p{{L}}\p{{N}}\n]*$', ' ', 'g')), chr(10)) AS ls FROM documents),
p AS (SELECT r, doc_id, list_transform(ls, lambda x: trim(regexp_replace(x, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS ls FROM c),
d AS (SELECT r, doc_id, ls, sha256({spelled}) AS text_digest FROM (SELECT *, array_to_string(list_filter(ls, lambda x: x <> ''), ' ') AS t FROM p)),
l AS (SELECT r, sha256({spelled}) AS line_digest FROM (SELECT r, unnest(list_distinct(ls)) AS t FROM d)),
h AS (
  SELECT r, list_sort(list(DISTINCT license_id)) AS line_licenses FROM l JOIN k ON line_digest = digest GROUP BY r)
SELECT doc_id, text_digest, license_id AS text_license, coalesce(line_licenses, []) AS line_licenses
FROM d LEFT JOIN k ON text_digest = digest LEFT JOIN h ON h.r = d.r
"""


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can state: sizes and targets."""
    return op4_sainte_lague_mix(spark, sf_dir).select("doc_id", "size", "source_size", "target")


MIX_TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS words FROM s),
-- the level at which weight * level, none above its cap, adds up to all words: the first that lies below a cap where only smaller ones are met
v AS (
  SELECT (a.words - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight), 0))
         / sum(b.weight) FILTER (WHERE b.cap / b.weight >= a.cap / a.weight) AS level, a.cap / a.weight AS mark
  FROM w a, w b GROUP BY a.source, a.words, a.cap, a.weight),
l AS (SELECT arg_min(level, mark) FILTER (WHERE level < mark) AS level FROM v)
SELECT d.doc_id, d.size, w.source_size, least(CAST(cap AS DOUBLE), coalesce(level, 'inf'::DOUBLE) * weight) AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, l
"""


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), key="pseudonym-key-1")


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256,
       CAST(1 AS BIGINT) AS n_rows
FROM d JOIN g ON d.t = g.t
"""

def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, min(page_id) AS first_id FROM p GROUP BY t),
b AS (
  SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      ((CAST('0x' || substr(h, 1 + (5 * i) // 4, 1) AS INTEGER) * 16
        + CAST('0x' || substr(h || '0', 2 + (5 * i) // 4, 1) AS INTEGER)) >> (3 - (5 * i) % 4)) & 31), 1), ''
    ORDER BY i) AS payload_digest
  FROM (SELECT page_id, h, unnest(range(0, 32)) AS i FROM p) GROUP BY page_id)
SELECT p.page_id, CAST(octet_length(encode(p.t)) AS BIGINT) AS payload_bytes, b.payload_digest,
       CASE WHEN p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM p JOIN f ON p.t = f.t JOIN b ON b.page_id = p.page_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS h FROM documents),
k AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS p3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS p4 FROM d),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain'
              WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM s
"""


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, w[i:i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, w[i:i + k - 1] AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT len(g) AS k FROM win))),
hit AS (SELECT DISTINCT doc_id, i, g FROM dw WHERE g IN (SELECT g FROM win)),
n_hit AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + len(g))) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT doc_id, item FROM hit JOIN win USING (g)) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
cnt AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
-- near: a window's rarest word, and 15 words in a row around it that hold all of the window's words
rare AS (SELECT g, arg_min(t, c) AS t FROM (SELECT DISTINCT g, unnest(g) AS t FROM win) JOIN cnt USING (t) GROUP BY g),
near AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT tok.doc_id, rare.g, d.w, unnest(range(greatest(tok.p - 14, 1), tok.p + 1)) AS a
    FROM tok JOIN rare USING (t) JOIN d ON d.doc_id = tok.doc_id)
  WHERE list_has_all(w[a:a + 14], g)),
n_near AS (SELECT doc_id, count(DISTINCT item) AS n FROM near JOIN win USING (g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.l, '')) AS items_sha256,
       coalesce(n_hit.n, 0) > 0 AS contaminated, CAST(coalesce(n_near.n, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN n_near USING (doc_id)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS b(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS l FROM bits WHERE k = 8),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a // 256, l[1 + xor(a % 256, b)]))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc),
own AS (
  SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN o ON o.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND p > h),
r AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY part, p) AS ts FROM own GROUP BY conv_id),
s AS (SELECT c.conv_id, coalesce(ts, []) AS ts FROM c LEFT JOIN r USING (conv_id)),
m AS (SELECT conv_id, len(ts) AS l, d, ts[1:d] AS k FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM s)),
g AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d), '') AS ends
  FROM m GROUP BY d, k),
ch AS (SELECT k[1:d - 1] AS pk, d - 1 AS pd, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
node AS (
  SELECT g.*, coalesce(ch.n, 0) AS n_children, CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END AS leaf,
         CASE WHEN g.d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].t) END AS saved
  FROM g LEFT JOIN ch ON ch.pk = g.k AND ch.pd = g.d),
up AS (SELECT leaf, saved, k[1:a] AS k, a AS d FROM (SELECT leaf, saved, k, unnest(range(0, d + 1)) AS a FROM node)),
roll AS (SELECT k, d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY k, d)
SELECT node.conv_id, node.d AS depth, par.conv_id AS parent_conv_id, node.n_convs, CAST(node.n_children AS BIGINT) AS n_children,
       CAST(roll.n_leaves AS BIGINT) AS n_leaves, CAST(roll.saved_tokens AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN roll ON roll.k = node.k AND roll.d = node.d
  LEFT JOIN g AS par ON node.d > 0 AND par.d = node.d - 1 AND par.k = node.k[1:node.d - 1]
"""

QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_odd_sketch_near_dedup": op2_odd_sketch_near_dedup,
    "op3_license_digests": op3_license_digests,
    "op4_sainte_lague_mix": op4_sainte_lague_mix,
    "mix_targets": mix_targets,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_bit_planes": op6_bit_planes,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_positional_index": op12_positional_index,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_line_frequency": OP1_SQL,
    "op2_odd_sketch_near_dedup": OP2_SQL,
    "op3_license_digests": _op3_sql(),
    "mix_targets": MIX_TARGETS_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_positional_index": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
