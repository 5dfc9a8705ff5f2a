import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from fixtures import documents, prose, spark_documents
from test_rules_and_dedup import brute_components, low
from test_text_operators import brute_targets

import corpus_pipeline
from palimpsest.llm import bpe, language_id, mixing, near_dedup
from palimpsest.llm.bpe import load_ranks
from palimpsest.llm.files import sized_slices
from palimpsest.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark):
    rng = random.Random(11)
    rows = documents() + [(900 + i, prose(rng, 30), ("en", "fr")[i % 2], f"src{i % 3}", 0, "x") for i in range(20)]
    docs = spark_documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    lettered = {r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
    left = rows_of(kept)
    assert {r[0] for r in left} <= lettered and len(left) >= 0.95 * len(lettered)

    unique = rows_of(stages["exact_dedup"](spark, spark_documents(spark, left), ""))
    best = {}
    for r in left:
        best[low(r[1])] = max(best.get(low(r[1]), -1), r[0])
    assert {r[0] for r in unique} == set(best.values())

    apart = rows_of(stages["near_dedup"](spark, spark_documents(spark, unique), ""))
    assert {r[0] for r in apart} == {i for i, (_, c) in brute_components(unique).items() if i == c}

    mixed = rows_of(stages["mixing"](spark, spark_documents(spark, apart), ""))
    texts, sizes, words = {r[0]: r[1] for r in apart}, Counter(), Counter()
    for r in apart:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in mixed:
        assert r[4] in (len(r[1]), next(x[4] for x in apart if x[0] == r[0]))
        words[r[3]] += len(WORD.findall(r[1]))
    chosen = Counter()
    for r in mixing.mix(spark_documents(spark, apart)).collect():
        own, in_parts = WORD.findall(texts[r["doc_id"]]), sum(b - a for a, b in r["parts"])
        chosen[r["doc_id"], tuple(own)] += (r["taken"] - in_parts) // len(own) if own else 0
        for a, b in r["parts"]:
            chosen[r["doc_id"], tuple(own[a:b])] += 1
    assert Counter((r[0], tuple(WORD.findall(r[1]))) for r in mixed) == +chosen
    for source, target in brute_targets(sizes).items():
        assert abs(words[source] - target) <= max(20, 0.02 * target)

    coded = stages["byte_bpe"](spark, spark_documents(spark, mixed), "").collect()
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r[0], tuple(tik.encode_ordinary(r[1]))) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded) == want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark_documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_need_little_memory_for_many_texts():
    """Executors of the pipeline have 3000 MB for two workers beside the JVM, so a slice of texts must be small."""
    rng = random.Random(5)
    some = [prose(rng, 300) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"text": [rng.choice(some) for _ in range(3000)]})
    scorer = language_id.Scorer(language_id.Model(public_tokenizers.path("piece_bpe_32k.model"), ["a"], np.full((40_000, 1), 1e-4)))
    uses = {
        "near_dedup": (near_dedup.BATCH_BYTES, lambda texts: shingle_sets([x.encode() for x in texts])),
        "language_id": (language_id.BATCH_BYTES, scorer.totals),
        "byte_bpe": (bpe.BATCH_BYTES, lambda texts: [text.split(" ") for text in texts]),
    }
    for name, (limit, use) in uses.items():
        tracemalloc.start()
        for part in sized_slices(batch, "text", limit):
            use(part.column("text").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20_000_000, (name, peak)
