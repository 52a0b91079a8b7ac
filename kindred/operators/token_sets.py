"""Pairs of texts with nearly the same tokens: an exact join of token sets that sends no tokens and few pairs.

Equal sets are one set.  A set's tokens are ordered by how often they occur,
the rarest first, so sets that are alike share one of the first few.  Each set
keeps a bitmap of the parity of its tokens by hash bit: two bitmaps differ in
no more bits than their sets differ in tokens.  Pairs that share a first token
are held against size and bitmap where they meet, so that hardly any but those
that are alike go on to be counted in full.  Sets that are alike share most of
their first tokens; they go on from those alone that follow another one in
either set, the least shared one among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import tokens
from kindred.sources import tables

#: Buckets in which tokens are counted for their order, which may be any; bits of a token's name in it; sets that are marked at once.
BUCKETS, NAME_BITS, AT_ONCE = 1 << 20, 40, 512
#: 64-bit words of the smallest bitmap and of the largest, and tokens for which the smallest is made.
LEAST_WORDS, MOST_WORDS, WORDS_FOR = 2, 1024, 300
#: Bits of a filter of ids, which is 2 MB of any number of them.
FILTER_BITS = 1 << 24


def _words(n: np.ndarray) -> np.ndarray:
    """Words of the bitmap of a set of n tokens: doubled as often as n is over ``WORDS_FOR``, doubled."""
    times = np.ceil(np.log2(np.maximum(n, WORDS_FOR) / WORDS_FOR)).astype(np.int64)
    return np.minimum(LEAST_WORDS << times, MOST_WORDS)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def marked(hashes: np.ndarray, n: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First tokens and bitmaps of sets whose tokens' hashes follow one another, n[i] of the i-th: names and their number, words and theirs."""
    own = np.repeat(np.arange(len(n)), n)
    names = counts[hashes & (BUCKETS - 1)] << NAME_BITS | hashes & ((1 << NAME_BITS) - 1)
    place = np.arange(len(hashes)) - np.repeat(_starts(n)[:-1], n)
    size = n - (percent * n + 99) // 100 + 1
    first = names[np.lexsort((names, own))][place < size[own]]
    words = _words(n)
    bit = (hashes.view(np.uint64) >> np.uint64(NAME_BITS)).astype(np.int64) & (64 * words - 1)[own]
    odd = np.bincount(64 * _starts(words)[own] + bit, minlength=64 * int(words.sum())) & 1
    return first, size, np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), words


def marks(hashes: Column, counts: np.ndarray, percent: int) -> Column:
    """``marked`` as a struct of two arrays, (first, bits), of each array of hashes."""
    lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(_starts(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(values)))

    @F.arrow_udf("struct<first: array<bigint>, bits: array<bigint>>")
    def each(held: pa.Array) -> pa.Array:
        made = []
        for at in range(0, len(held), AT_ONCE):
            some = held.slice(at, AT_ONCE)
            made.append(marked(some.flatten().to_numpy(zero_copy_only=False), some.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), counts, percent))
        if not made:
            return pa.array([], pa.struct([("first", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]))
        first, size, bits, words = zip(*made, strict=True)
        return pa.StructArray.from_arrays([lists(first, size), lists(bits, words)], names=["first", "bits"])

    return each(hashes)


def differing(x: Column, y: Column) -> Column:
    """Bits in which two bitmaps differ; the larger one is folded to the size of the smaller."""
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    folded = F.transform(small, lambda w, i: F.aggregate(F.filter(large, lambda _, j: j % F.size(small) == i), w, lambda a, v: a.bitwiseXOR(v)))
    apart = F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))).otherwise(folded)
    # most bitmaps are of the least size, for which code is compiled
    least = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, LEAST_WORDS)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return F.when((F.size(x) == LEAST_WORDS) & (F.size(y) == LEAST_WORDS), least).otherwise(F.aggregate(apart, F.lit(0), lambda a, w: a + F.bit_count(w)))


def first_rows(held: DataFrame, p: str) -> DataFrame:
    """(token, p, p_n, p_before, p_bits): a row for each first token, with the one before it (-1 before the least)."""
    each = F.transform("first", lambda t, i: F.struct(t.alias("token"), F.coalesce(F.get("first", i - 1), F.lit(-1)).alias("before")))
    return held.select(F.explode(each).alias("t"), F.col("id").alias(p), F.col("n").alias(f"{p}_n"), F.col("bits").alias(f"{p}_bits")).select("t.token", p, f"{p}_n", F.col("t.before").alias(f"{p}_before"), f"{p}_bits")


def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides with a token in common, but for those after one that is common too: the least shared one stays."""
    return a.join(b, "token").filter((F.col("a_before") != F.col("b_before")) | (F.col("a_before") < 0))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose id is in ``ids``; a filter of bounded size goes first, so that few others are moved."""
    place = F.xxhash64("id").bitwiseAND(F.lit(FILTER_BITS - 1))
    with tables.writing(rows.sparkSession):
        found = ids.select(place.cast("int").alias("place")).distinct().toArrow()["place"].to_numpy()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, found >> 3, np.left_shift(1, found & 7).astype(np.uint8))

    @F.arrow_udf("boolean")
    def known(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False)
        return pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return rows.filter(known(place)).join(ids, "id", "left_semi")


def _hashes(column: str) -> Column:
    return F.transform(F.split(column, " "), lambda t: F.xxhash64(t))


def alike(rows: DataFrame, percent: int) -> DataFrame:
    """(own_id, other_id) of rows (id long, own boolean, text), one of ``own`` and one not, whose sets of the
    space-separated tokens of their texts have a Jaccard similarity of ``percent`` or more; a text without tokens is
    like nothing.  The result is written to the shared folder."""
    spark = rows.sparkSession
    with tables.scratch(spark) as write:
        ready = rows.select("id", "own", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0).select("id", "own", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"), F.sort_array(F.transform("t", lambda t: F.xxhash64(t))).alias("h"))
        sets = write(ready.select("id", "own", "n", "tokens", F.xxhash64("h").alias("x"), F.hash("h").alias("y")), "sets")
        # the same set again: n and 96 bits of hash
        groups = write(sets.groupBy("n", "x", "y").agg(F.min("id").alias("id"), F.collect_list(F.when(F.col("own"), F.col("id"))).alias("owns"), F.collect_list(F.when(~F.col("own"), F.col("id"))).alias("others")).drop("x", "y"), "groups")
        with tables.writing(spark):
            counted = sets.select(F.explode(_hashes("tokens")).alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count("*").cast("int").alias("k")).toArrow()
        counts = np.zeros(BUCKETS, np.int64)
        counts[counted["bucket"].to_numpy()] = np.minimum(counted["k"].to_numpy(), (1 << 63 - NAME_BITS) - 1)
        one = groups.select("id", (F.size("owns") > 0).alias("has_own"), (F.size("others") > 0).alias("has_other"))
        held = write(sets.select("id", "n", marks(_hashes("tokens"), counts, percent).alias("m")).join(one.hint("merge"), "id").select("id", "n", "m.*", "has_own", "has_other"), "marks")
        n, m = F.col("a_n"), F.col("b_n")
        shared = F.ceil(percent * (n + m) / (100 + percent))
        met = meeting(first_rows(held.filter("has_own"), "a"), first_rows(held.filter("has_other"), "b")).filter((F.col("a") != F.col("b")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)))
        near = write(met.filter(differing(F.col("a_bits"), F.col("b_bits")) <= n + m - 2 * shared).select("a", "b").distinct(), "near")
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = write(only(sets.select("id", "tokens"), ids), "texts")
        of = lambda p: texts.select(F.col("id").alias(p), F.col("tokens").alias(f"{p}_tokens"))
        x, y = F.split("a_tokens", " "), F.split("b_tokens", " ")
        both = near.join(of("a"), "a").join(of("b"), "b").filter((100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))).select("a", "b")
        owns, others = groups.select(F.col("id").alias("a"), "owns"), groups.select(F.col("id").alias("b"), "others")
        linked = both.join(owns, "a").join(others, "b").select("owns", "others").unionByName(groups.select("owns", "others"))
        return tables.materialised(linked.select("others", F.explode("owns").alias("own_id")).select("own_id", F.explode("others").alias("other_id")), "alike")
