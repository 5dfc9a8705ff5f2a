"""Small documents with the cases that operators must stand."""

import random
from fractions import Fraction

WORDS = "the of and in that was for on with as his they at be this have from or one had by".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, tag string"


def prose(rng: random.Random, n: int) -> str:
    made = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w if rng.random() < 0.6 else rng.choice(WORDS) for w in made)


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


def documents(seed: int = 1) -> list[tuple]:
    """Prose, exact copies with other case, near copies of several distances, shared lines, nulls, empty, odd white space,
    a very long text, text without words or letters."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    base = [prose(rng, 80) for _ in range(6)]
    texts += [edited(rng, b, k) for b in base for k in range(0, 12)]
    chain = base[0]
    for _ in range(10):  # neighbours are alike, ends are not
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [texts[3].upper(), texts[3], texts[5], texts[5] + " ", None, None, "", "   \n\t ", "one", "One", "one two", "12 34 !"]
    texts += ["\n".join(["shared line of the host", prose(rng, 20)]) for _ in range(15)]
    texts += ["a b c d e f " * 10, prose(rng, 30_000), "x" * 5000, "é È ß\x0bnbsp word\x1cend", "same line\nsame line\nother"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    return rows


def spark_documents(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC)


def slow_apportionment(votes, seats, caps):
    """Seats one by one to the highest quotient, ties to the first party."""
    won, seats = [0] * len(votes), min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and won[i] < caps[i]]
        won[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i))] += 1
    return won
