import random

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import token_sets


def jaccard(x: str, y: str) -> bool:
    a, b = set(x.split()), set(y.split())
    return bool(a) and 100 * len(a & b) >= 90 * len(a | b)


def test_alike_against_brute_force(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    texts: list[str | None] = [None, "", "  ", "one", "one one", "one two"]
    for n in (1, 5, 9, 10, 19, 20, 40, 599, 600, 640, 1250):
        base = words(n)
        for change in (0, 0, 1, n // 30, n // 19, n // 12, n // 8):
            texts.append(" ".join(base[change:] + words(r.randrange(change + 1))))
    rows = [(i, i % 3 == 0, t) for i, t in enumerate(texts)]
    got = [tuple(x) for x in token_sets.alike(spark.createDataFrame(rows, "id long, own boolean, text string"), 90).collect()]
    want = {(i, j) for i, a, x in rows for j, b, y in rows if a and not b and jaccard(x or "", y or "")}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_a_token_of_all_texts_is_no_first_token():
    """The longest token came first, so that a long one that all texts have brought all of them together."""
    r = np.random.default_rng(1)
    common, n = 12345, 40
    sets = [np.append(r.integers(-(2**62), 2**62, n - 1), common) for _ in range(600)]
    counts = np.bincount(np.concatenate(sets) & (token_sets.BUCKETS - 1), minlength=token_sets.BUCKETS)
    first, size, bits, words = token_sets.marked(np.concatenate(sets), np.full(600, n), counts, 90)
    assert set(size) == {5} and np.unique(first, return_counts=True)[1].max() < 5
    assert set(words) == {token_sets.LEAST_WORDS}
    bits = bits.view(np.uint64)
    apart = np.bitwise_count(bits.reshape(600, -1)[0] ^ bits.reshape(600, -1)[1:]).sum(1)
    assert (apart > 8).all() and (apart <= 2 * n).all()  # none of these is near enough to be counted in full


def test_bitmaps_of_two_sizes(spark):
    r = np.random.default_rng(2)
    x = r.integers(-(2**62), 2**62, 1250)
    y = x[:1190]
    counts = np.ones(token_sets.BUCKETS, np.int64)
    _, _, bits, words = token_sets.marked(np.concatenate([x, y]), np.array([len(x), len(y)]), counts, 90)
    assert words.tolist() == [16, 8]
    row = spark.createDataFrame([(bits[:16].tolist(), bits[16:].tolist())], "x array<bigint>, y array<bigint>").select(token_sets.differing(F.col("x"), F.col("y")), token_sets.differing(F.col("y"), F.col("x"))).first()
    assert row[0] == row[1] and 0 < row[0] <= 60


def test_near_copies_meet_few_times(spark):
    """A pair went on from each first token that it shares, so that the rows moved grew with the length of the texts."""
    rows = [(i, i % 2 == 0, 400, sorted([*range(1, 40), 100 + i]), [0, 0]) for i in range(20)]
    held = spark.createDataFrame(rows, "id long, own boolean, n int, first array<bigint>, bits array<bigint>")
    a, b = token_sets.first_rows(held.filter("own"), "a"), token_sets.first_rows(held.filter("not own"), "b")
    met = token_sets.meeting(a, b)
    assert a.join(b, "token").count() == 39 * 100
    assert met.count() == met.select("a", "b").distinct().count() == 100


def test_only_some_ids(spark):
    """The texts of all sets were moved to find those of the pairs that are counted in full."""
    rows = spark.range(5000).withColumn("tokens", F.lit("x"))
    some = spark.range(0, 5000, 50)
    assert sorted(r["id"] for r in token_sets.only(rows, some).collect()) == list(range(0, 5000, 50))
    assert token_sets.only(rows, some.limit(0)).count() == 0
