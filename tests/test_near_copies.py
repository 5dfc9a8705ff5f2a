import random

from palimpsest.operators import relate


def near(a, b):
    """Whether one edit or none leads from a to b."""
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_near_copies_are_the_brute_force(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abA") for _ in range(rng.randrange(0, 6))), rng.choice([1, 2, None])) for _ in range(150)] + [(None, 1), ("ab", 1), ("ab", 1)]
    got = relate.near_copies(spark.createDataFrame(rows, "n string, v int"), "n", "v").collect()
    own = {(v, n) for n, v in rows if n is not None}
    want = set()
    for v, n in own:
        others = [m for w, m in own if w == v and m != n and near(n.lower(), m.lower())]
        want.add((v, n, len(others), min([n, *others])))
    assert {tuple(r) for r in got} == want and len(got) == len(own)
    assert relate.near_copies(spark.createDataFrame([], "n string, v int"), "n", "v").count() == 0
