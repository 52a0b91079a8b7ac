"""N-gram Jaccard join with several global token orders, and its connected components.

Sets are shingles of words.  The plan, with nothing gathered on the driver but
tables of fixed size:

1. Document frequencies: every task sends its shingles as packed sorted runs;
   each range of hashes keeps its most frequent ones (a fixed number in all).
   They only shape the first order, so exactness never rests on them.
2. Each distinct set (copies collapse) keeps its prefix under order A, rare
   shingles first, and a sketch: counts of its shingles by hash bucket.  Two
   sets with the wanted overlap share a token of their prefixes, and the
   bucket-wise minimum of their sketches sums to the overlap at least.
3. Prefix tokens meet in buckets.  Each token's block names one pivot; pairs
   with pivots that pass the length, position and sketch filters are candidates.
4. Candidates must also share prefix tokens under the orders B and C; what
   passes all filters is verified on whole sets.
5. Pairs of a block that are then still in different components are looked for
   in the same way, all pairs of a block, large blocks tile by tile inside the
   workers; only pairs that pass the sketch filter leave a worker.
6. ``join`` ends here.  ``linked`` counts every link: links never leave a
   component, so the sets of a component meet tile by tile, and a worker sends
   one count per set and tile, not the pairs.  ``link_pairs`` sends the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, hashed_words, mix, pack_columns, pack_sorted, shingle_hashes, shuffle_width, table, unpack_columns, unpack_sorted, writing, written
from .graph import components

#: Frequent shingles kept for order A, and members of one salt of a frequent token's block.
FREQUENT, SALT_ROWS = 1 << 17, 4096
#: Blocks up to this size are searched for partners when they are built.
SMALL_BLOCK = 64
LOW48 = np.uint64((1 << 48) - 1)


def token_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending 64-bit shingle hashes) of every text with a word."""
    for first, words, offsets in hashed_words(column):
        for i in range(len(offsets) - 1):
            if offsets[i + 1] > offsets[i]:
                yield first + i, np.unique(shingle_hashes(words[offsets[i] : offsets[i + 1]], width))


def need(n, percent: int):
    """The least overlap of a set of n with any partner; also the size a partner must have."""
    return (n * percent + 99) // 100


def overlap_needed(n, m, percent: int):
    """The least overlap of sets of n and m at ``percent`` of their union."""
    return -(-percent * (n + m) // (100 + percent))


# --- 1. frequencies ---------------------------------------------------------------


def _runs(batches, width: int, bits: int):
    """(range, packed run) of the 32-bit tokens of a task's distinct sets."""
    held, count, seen = [], 0, set()

    def flush():
        tokens = np.sort(np.concatenate(held))
        edges = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
        rows = [(r, pack_sorted(tokens[a:b])) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in rows], pa.int32()), "run": pa.array([b for _, b in rows], pa.binary())})

    for batch in batches:
        for _, tokens in token_sets(batch.column(0), width):
            key = int(np.bitwise_xor.reduce(mix(tokens, 31))), len(tokens)
            if key in seen:
                continue
            if len(seen) < 500_000:
                seen.add(key)
            held.append(tokens >> np.uint64(32))
            count += len(tokens)
            if count > 1_000_000:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


def frequent_tokens(docs: DataFrame, width: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(32-bit tokens ascending, frequencies): at most FREQUENT of them, whatever the corpus."""
    bits = max(6, int(np.ceil(np.log2(4 * shuffle_width(docs.sparkSession)))))
    most = max(1, FREQUENT >> bits)

    def merge(t: pa.Table) -> pa.Table:
        tokens = np.concatenate([unpack_sorted(b.as_py()) for b in t.column("run")])
        values, counts = np.unique(tokens, return_counts=True)
        keep = np.flatnonzero(counts >= 3)
        keep = keep[np.argsort(-counts[keep], kind="stable")[:most]]
        return pa.table({"token": pa.array(values[keep].astype(np.int64)), "df": pa.array(counts[keep].astype(np.int64))})

    runs = docs.select(text_col).mapInArrow(lambda b: give_back(_runs(b, width, bits)), "range int, run binary")
    with writing(docs.sparkSession):
        found = runs.groupBy("range").applyInArrow(merge, "token long, df long").toArrow()
    tokens = found.column("token").to_numpy().astype(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("df").to_numpy()[order]


class Order:
    """Order A: frequency, then a hash; unknown tokens are rare and come first."""

    def __init__(self, tokens: np.ndarray, df: np.ndarray):
        self.tokens, self.df = tokens, df.astype(np.int64)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(tokens >> np.uint64(12)).astype(np.int64)] = True

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        short = tokens >> np.uint64(32)
        maybe = np.flatnonzero(self.hint[(short >> np.uint64(12)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.tokens, short[maybe])
            at[at == len(self.tokens)] = 0
            hit = self.tokens[at] == short[maybe]
            out[maybe[hit]] = self.df[at[hit]]
        return out

    def prefix(self, tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        df = self.frequency(tokens)
        first = np.lexsort((mix(tokens, 41), df))[:size]
        return tokens[first], df[first]


# --- 2. signatures ------------------------------------------------------------------

SIGNATURE = "doc_id long, n long, s1 long, s2 long, prefix binary, sketch binary"
KEY = ["s1", "s2", "n"]
#: log2 of a sketch's buckets, and the largest set that has so many; larger sets have none.
SKETCHES = ((5, 512), (6, 2_048), (8, 16_384), (10, 65_536), (12, 262_144))


def _sums(tokens: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two hashes of a whole set; with its size they stand for it."""
    return np.bitwise_xor.reduce(mix(tokens, 31)).view(np.int64), np.sum(mix(tokens, 37), dtype=np.uint64).view(np.int64)


def sketch(tokens: np.ndarray) -> bytes | None:
    """Counts of the tokens by hash bucket, a byte each; None (which lets every pair through) where they don't fit."""
    for bits, most in SKETCHES:
        if len(tokens) <= most:
            counts = np.bincount((mix(tokens, 71) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None
    return None


class Sketches:
    """Sketches of many sets at each resolution; a finer one also serves at a coarser, by adding neighbours."""

    def __init__(self, blobs: list[bytes | None]):
        self.levels, whole = [], [np.frombuffer(b, np.uint8) if b is not None else None for b in blobs]
        for bits, _ in SKETCHES:
            has = [i for i, w in enumerate(whole) if w is not None and len(w) >= 1 << bits]
            place = np.full(len(blobs), -1)
            place[has] = np.arange(len(has))
            rows = [whole[i].reshape(1 << bits, -1).sum(1, dtype=np.uint16) for i in has]
            self.levels.append((place, np.stack(rows) if rows else np.empty((0, 1 << bits), np.uint16)))

    def pass_on(self, x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Which pairs (x[i], y[i]) may have an overlap of wanted[i]."""
        keep = np.ones(len(x), bool)
        for place, rows in self.levels:
            at = np.flatnonzero(keep & (place[x] >= 0) & (place[y] >= 0))
            size = max(1, (1 << 22) // rows.shape[1])
            for i in range(0, len(at), size):
                some = at[i : i + size]
                most = np.minimum(rows[place[x[some]]], rows[place[y[some]]]).sum(1, dtype=np.int64)
                keep[some] = most >= wanted[some]
        return keep


def _signatures(batches, width: int, percent: int, frequent):
    order = Order(*frequent.value)
    for batch in batches:
        n_rows = batch.num_rows
        n, s1, s2, prefix, counts = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), [None] * n_rows, [None] * n_rows
        for i, tokens in token_sets(batch.column(1), width):
            n[i] = len(tokens)
            s1[i], s2[i] = _sums(tokens)
            chosen, df = order.prefix(tokens, len(tokens) - need(len(tokens), percent) + 1)
            prefix[i], counts[i] = pack_columns(chosen & LOW48, df), sketch(tokens)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(s1), pa.array(s2), pa.array(prefix, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "s1", "s2", "prefix", "sketch"])


# --- 3. blocks ----------------------------------------------------------------------


def _bucketed(batches, buckets: int):
    """(bucket, packed rows) of prefix tokens; a frequent token's rows are dealt over salts."""
    held, count = [], 0

    def flush():
        token, doc, n, pos, salted, bucket = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                rows.append((b, pack_columns(token[at], doc[at], n[at], pos[at], salted[at])))
        return pa.RecordBatch.from_pydict({"bucket": pa.array([r for r, _ in rows], pa.int32()), "rows": pa.array([b for _, b in rows], pa.binary())})

    for batch in batches:
        for doc, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            token, df = unpack_columns(blob, 2)
            size = len(token)
            salts = df // np.uint64(SALT_ROWS) + np.uint64(1)
            own = mix(np.full(size, doc, np.int64).astype(np.uint64), 43) % salts
            bucket = (mix(token * np.uint64(0x9E3779B97F4A7C15) + own, 47) % np.uint64(buckets)).astype(np.int64)
            held.append((token, np.full(size, doc, np.int64).view(np.uint64), np.full(size, n, np.uint64), np.arange(size, dtype=np.uint64), salts > 1, bucket))
            count += size
        if count > 400_000:
            yield flush()
            held, count = [], 0
    if held:
        yield flush()


BLOCKS = "token long, doc long, n long, pos long, pivot long, pivot_n long, pivot_pos long"


def _blocks(t: pa.Table, percent: int) -> pa.Table:
    """Rows of tokens that two sets share, or that are salted, each with its block's pivot."""
    token, doc, n, pos, salted = (np.concatenate(c) for c in zip(*(unpack_columns(b.as_py(), 5) for b in t.column("rows")), strict=True))
    order = np.lexsort((doc, pos, token))
    token, doc, n, pos, salted = (x[order] for x in (token, doc, n, pos, salted))
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.append(first, len(token)))
    lead, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    # in small blocks only rows with a partner that passes the length and position filters can matter
    keep = (size > SMALL_BLOCK) | (salted > 0)
    for d in range(1, min(SMALL_BLOCK, int(sizes.max(initial=0)))):
        a = np.flatnonzero(size[:-d] <= SMALL_BLOCK)
        a = a[token[a] == token[a + d]]
        if not len(a):
            break
        x, y = n[a].astype(np.int64), n[a + d].astype(np.int64)
        left = np.minimum(x - pos[a].astype(np.int64), y - pos[a + d].astype(np.int64))
        a = a[(100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (left >= overlap_needed(x, y, percent))]
        keep[a] = keep[a + d] = True
    cols = (token, doc, n, pos, doc[lead], n[lead], pos[lead])
    return pa.table({name: pa.array(c[keep].view(np.int64)) for name, c in zip(("token", "doc", "n", "pos", "pivot", "pivot_n", "pivot_pos"), cols, strict=True)})


# --- 4. verification ----------------------------------------------------------------

#: Bits of an id bitmap: 16 for each id, within these bounds; 2**27 bits are 16 MB, whatever the corpus.
LEAST_BITS, MOST_BITS, _SLICES = 16, 27, 64


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids of bounded size, for a first cut before an exact join."""
    size = min(MOST_BITS, max(LEAST_BITS, 4 + ids.count().bit_length()))
    per = 1 << (size - 3 - 6)

    def mark(batches):
        bits = np.zeros(1 << size, bool)
        for batch in batches:
            bits[(mix(batch.column(0).to_numpy().astype(np.uint64), 53) >> np.uint64(64 - size)).astype(np.int64)] = True
        parts = np.packbits(bits).reshape(_SLICES, per)
        some = [i for i in range(_SLICES) if parts[i].any()]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "bits": pa.array([parts[i].tobytes() for i in some], pa.binary())})

    def union(t: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce(np.stack([np.frombuffer(b.as_py(), np.uint8) for b in t.column("bits")]), axis=0)
        return pa.table({"slice": t.column("slice").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros((_SLICES, per), np.uint8)
    for row in ids.mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(union, "slice int, bits binary").collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _sets(batches, width: int, percent: int, bitmap):
    """(doc, n, s1, s2, b, c, tokens) of the texts whose id the bitmap has: 48-bit sets, prefixes of orders B and C."""
    bits = np.unpackbits(bitmap.value).view(bool)
    shift = np.uint64(64 - (len(bits).bit_length() - 1))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        keep = bits[(mix(ids.astype(np.int64).view(np.uint64), 53) >> shift).astype(np.int64)]
        if not keep.any():
            continue
        batch = batch.filter(pa.array(keep))
        ids, rows = batch.column(0).to_pylist(), []
        for i, tokens in token_sets(batch.column(1), width):
            size = len(tokens) - need(len(tokens), percent) + 1
            b = np.partition(mix(tokens, 61), size - 1)[:size] >> np.uint64(24)
            c = np.partition(mix(tokens, 67), size - 1)[:size] >> np.uint64(24)
            rows.append((ids[i], len(tokens), *_sums(tokens), pack_sorted(np.sort(b)), pack_sorted(np.sort(c)), pack_sorted(np.unique(tokens & LOW48))))
            if len(rows) >= 500:
                yield _set_batch(rows)
                rows = []
        if rows:
            yield _set_batch(rows)


SETS = "doc long, n long, s1 long, s2 long, b binary, c binary, tokens binary"


def _set_batch(rows):
    kinds = (*[pa.int64()] * 4, *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "n", "s1", "s2", "b", "c", "tokens"])


def _share(x: bytes, y: bytes) -> bool:
    a, b = unpack_sorted(x), unpack_sorted(y)
    return len(np.intersect1d(a, b, assume_unique=True)) > 0


def _filter_pairs(batches):
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(2, 6)]
        keep = [_share(bx, by) and _share(cx, cy) for bx, cx, by, cy in zip(*cols, strict=True)]
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _verify_pairs(batches, percent: int):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = unpack_sorted(a), unpack_sorted(b)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, width: int, percent: int, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(x, y) of the candidate pairs that link, and the sets of the ids that passed the sketch filter (and of ``also``)."""
    side = lambda d, name, *cols: d.select(F.col("doc").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in cols))
    looked = pairs.join(side(sketches, "x", "n", "sketch"), "x").join(side(sketches, "y", "n", "sketch"), "y")
    alike = lambda b: give_back(_sketch_pairs(b, percent))
    near = written(looked.select("x", "y", "x_n", "y_n", "x_sketch", "y_sketch").mapInArrow(alike, "x long, y long").distinct(), "alike")
    ids = near.select(F.col("x").alias("doc")).union(near.select("y"))
    bitmap = pairs.sparkSession.sparkContext.broadcast(id_bitmap((ids.union(also) if also is not None else ids).distinct()))
    # a repeated id may have several texts: the class's own is the one with its hashes; all are kept
    sets = written(rows.filter("doc_id is not null").mapInArrow(lambda b: give_back(_sets(b, width, percent, bitmap)), SETS), "sets", "none")
    shared = near.join(side(sets, "x", "b", "c"), "x").join(side(sets, "y", "b", "c"), "y").select("x", "y", "x_b", "x_c", "y_b", "y_c")
    shared = written(shared.mapInArrow(lambda b: give_back(_filter_pairs(b)), "x long, y long"), "candidates")
    whole = shared.join(side(sets, "x", "tokens"), "x").join(side(sets, "y", "tokens"), "y").select("x", "y", "x_tokens", "y_tokens")
    links = written(whole.mapInArrow(lambda b: give_back(_verify_pairs(b, percent)), "x long, y long"), "links")
    discard(near, shared)
    return links, sets


def _sketch_pairs(batches, percent: int):
    for batch in batches:
        n, m = (batch.column(i).to_numpy() for i in (2, 3))
        some = Sketches([*batch.column(4).to_pylist(), *batch.column(5).to_pylist()])
        at = np.arange(batch.num_rows)
        fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        yield batch.select(["x", "y"]).filter(pa.array(fits & some.pass_on(at, at + len(at), overlap_needed(n, m, percent)), pa.bool_()))


def _fits(n, pos, m, other, percent: int):
    """Length and position filters of a shared token at ``pos`` of n and ``other`` of m."""
    small, large = F.least(n, m), F.greatest(n, m)
    wanted = F.ceil((F.lit(percent) * (n + m)) / F.lit(100 + percent))
    return (small * 100 >= large * percent) & (F.least(n - pos, m - other) >= wanted)


def _index(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id and text, signatures of rows, classes of equal sets, blocks), the last three written."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(rows, width))
    signs = written(rows.mapInArrow(lambda b: give_back(_signatures(b, width, percent, frequent)), SIGNATURE), "signatures", "none")
    reps = written(signs.filter("n > 0 and doc_id is not null").groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.count("*").alias("rows")), "classes", "none")

    buckets = 4 * shuffle_width(spark)
    packed = reps.select("rep", "n", "prefix").mapInArrow(lambda b: give_back(_bucketed(b, buckets)), "bucket int, rows binary")
    blocks = written(packed.groupBy("bucket").applyInArrow(lambda t: _blocks(t, percent), BLOCKS), "blocks")
    return rows, signs, reps, blocks


# --- 5. pairs inside groups, in the workers -------------------------------------------

#: Rows of a tile of a large group, shingles of one, and pairs looked at together.
TILE, TILE_TOKENS, TOGETHER = 1024, 1 << 20, 1 << 20


def _meetings(group: np.ndarray, own: np.ndarray, apart: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) of rows of one group that pass the length filter, n[a] <= n[b], some at a time.

    ``group`` numbers the groups; where a group is a cell of two tiles
    (``apart``), rows of one tile (``own``) don't meet: they do so elsewhere.
    """
    order = np.lexsort((n, group))
    g, size = group[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    last, two = np.append(first[1:], len(g)) - 1, apart[order]
    tile, reach = own[order], np.zeros(len(g), np.int64)
    for a, b in zip(first, last, strict=True):
        if b > a:
            # the furthest row that is not too large for this one
            reach[a : b + 1] = np.searchsorted(size[a : b + 1], 100 * size[a : b + 1] // percent, side="right") + a - 1 - np.arange(a, b + 1)
    held, count = [], 0
    alive = np.flatnonzero(reach > 0)
    d = 1
    while len(alive):
        pick = alive[~two[alive] | (tile[alive] != tile[alive + d])]
        held.append((pick, pick + d))
        count += len(pick)
        if count >= TOGETHER:
            yield tuple(order[np.concatenate(k)] for k in zip(*held, strict=True))
            held, count = [], 0
        d += 1
        alive = alive[reach[alive] >= d]
    if count:
        yield tuple(order[np.concatenate(k)] for k in zip(*held, strict=True))


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row of the columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _cells(rows: DataFrame, more: DataFrame, key: str, by: str) -> DataFrame:
    """Deals rows of large groups to cells (one, two) of two tiles: a row goes to the cells of its own tile.

    ``more`` has (key, more) of the groups of more than one tile, and their
    number of tiles less one.
    """
    dealt = rows.join(more, key, "left").withColumn("more", F.coalesce("more", F.lit(0)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(by), F.col("more") + 1).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("more"))))
    return dealt.withColumns({"one": F.least("own", "with"), "two": F.greatest("own", "with")}).drop("with", "more")


def _unlinked_pairs(t: pa.Table, percent: int) -> pa.Table:
    """Pairs of a bucket's blocks in different components that pass the length, position and sketch filters."""
    get = lambda name: t.column(name).to_numpy()
    group, label = _numbered(get("token"), get("one"), get("two")), get("label")
    # blocks whose rows are all in one component have nothing to find
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0)))
    mixed = np.minimum.reduceat(label[order], starts) != np.maximum.reduceat(label[order], starts)
    t = t.filter(pa.array(mixed[group]))
    found = [np.empty((0, 2), np.int64)]
    if t.num_rows:
        group, label, doc, n, pos, pivot = group[mixed[group]], *(get(k) for k in ("label", "doc", "n", "pos", "pivot"))
        sketches = Sketches(t.column("sketch").to_pylist())
        for a, b in _meetings(group, get("own"), get("one") != get("two"), n, percent):
            wanted = overlap_needed(n[a], n[b], percent)
            # a block's pairs with its pivot were candidates before
            keep = (label[a] != label[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= wanted) & (pivot[a] != doc[b]) & (pivot[b] != doc[a])
            a, b, wanted = a[keep], b[keep], wanted[keep]
            keep = sketches.pass_on(a, b, wanted)
            x, y = doc[a[keep]], doc[b[keep]]
            found.append(np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"x": pa.array(pairs[:, 0]), "y": pa.array(pairs[:, 1])})


def _several(signs: DataFrame) -> DataFrame:
    """Ids with more than one set."""
    return signs.filter("n > 0 and doc_id is not null").select("doc_id", *KEY).distinct().groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")


def _links(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str):
    """(signatures, classes, links that connect every component, sets of all ids in links), written."""
    rows, signs, reps, blocks = _index(docs, width, percent, id_col, text_col)
    c = F.col
    sketches = reps.select(c("rep").alias("doc"), "n", "sketch")
    first = blocks.filter(c("doc") != c("pivot")).filter(_fits(c("n"), c("pos"), c("pivot_n"), c("pivot_pos"), percent))
    pairs = first.select(F.least("doc", "pivot").alias("x"), F.greatest("doc", "pivot").alias("y")).distinct()
    links, sets = verified(pairs, rows, sketches, width, percent)
    labels = components(links.select(c("x").alias("a"), c("y").alias("b")))

    spark, buckets = docs.sparkSession, 4 * shuffle_width(docs.sparkSession)
    known = sketches.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", "sketch", F.coalesce("component", "doc").alias("label"))
    # written, so that the join's sides are plain tables: Spark broadcasts a small one, or may split a large token's rows
    large = written(blocks.groupBy("token").agg((F.count("*") / F.lit(TILE)).cast("int").alias("more")).filter("more > 0"), "large")
    met = _cells(blocks.select("token", "doc", "n", "pos", "pivot"), large, "token", "doc").join(known, ["doc", "n"])
    met = met.select(F.pmod(F.xxhash64("token", "one", "two"), F.lit(buckets)).alias("bucket"), "token", "one", "two", "own", "doc", "n", "pos", "pivot", "label", "sketch")
    rest = met.groupBy("bucket").applyInArrow(lambda t: _unlinked_pairs(t, percent), "x long, y long").distinct()
    rest = written(rest, "unlinked")
    several = written(_several(signs), "several")
    more, further = verified(rest, rows, sketches, width, percent, several)
    every = written(links.union(more).distinct(), "links")
    ids = every.select(c("x").alias("doc")).union(every.select("y")).union(several).distinct()
    sets_of_all = written(sets.union(further).join(ids, "doc", "left_semi"), "sets", "none")
    discard(blocks, links, labels, large, rest, more, sets, further, several)
    return signs, reps, every, sets_of_all


def _labelled(signs: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """(s1, s2, n, rep, component) of every class that ``links(x, y)`` or repeated ids connect with another."""
    classes = signs.filter("n > 0 and doc_id is not null").select("doc_id", *KEY).distinct()
    # an id with several texts makes their classes one; such ids alone are joined with their classes
    of_several = classes.join(_several(signs), "doc_id", "left_semi").join(reps.select(*KEY, "rep"), KEY)
    twins = of_several.groupBy("doc_id").agg(F.min("rep").alias("a")).join(of_several.select("doc_id", F.col("rep").alias("b")), "doc_id").select("a", "b")
    final = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(twins))  # a self loop keeps its node
    return reps.select(*KEY, "rep").join(final.withColumnRenamed("node", "rep"), "rep")


#: A class is hot from this share of all rows on, so there are at most as many hot ones; and rows of one salt of it.
HOT_SHARE, SALTED = 10_000, 1000


def _of_rows(signs: DataFrame, reps: DataFrame, info: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, more) of every row, from classes' ``info``.

    A row without words has the component of its id's other rows, if there are
    any, and 0 elsewhere; rows without an id have no component.  The rows of a
    hot class are dealt over salts, its one row of ``info`` goes to each; hot
    classes are HOT_SHARE at most, whatever the corpus, so they are broadcast.
    """
    most = max(SALTED, signs.count() // HOT_SHARE)
    hot = F.broadcast(reps.filter(F.col("rows") > most).select(*KEY, F.ceil(F.col("rows") / SALTED).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    rows = signs.select("doc_id", *KEY).join(hot, KEY, "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).drop("salts")
    info = info.join(hot, KEY, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    count = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in more]
    nothing = [F.lit(0).cast("long").alias(c) for c in more]
    named = rows.filter("n > 0 and doc_id is not null")
    out = named.join(info, [*KEY, "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *count)
    blank = rows.filter("n = 0 and doc_id is not null").select("doc_id")
    others = named.join(blank.distinct(), "doc_id", "left_semi").join(info, [*KEY, "salt"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = out.unionByName(blank.join(others, "doc_id", "left").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *nothing))
    return out.unionByName(rows.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), *nothing))


def join(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer
    than ``width`` words is one shingle; one without words, or null, has none
    and links with nothing.  Very long texts are hashed piece by piece and
    compared whole.  Sets link when ``100 * both >= percent * either``;
    component_id is the least id reachable, its own included.  Rows that repeat
    an id are one node: their texts count as linked.  A null id keeps its row
    with a null component.  Empty tables give no rows; other columns are
    ignored.  Shingles are compared by 64-bit (in verification 48-bit) hashes.
    """
    signs, reps, links, sets = _links(docs, width, percent, id_col, text_col)
    labelled = _labelled(signs, reps, links).select(*KEY, "component")
    info = reps.select(*KEY, "rep").join(labelled, KEY, "left").select(*KEY, F.coalesce("component", "rep").alias("component_id"))
    out = written(_of_rows(signs, reps, info), "components")
    discard(signs, reps, links, sets)
    return out


# --- 6. every link ------------------------------------------------------------------


def _overlaps(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets x[i] and y[i]; x is ascending."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    lengths = np.array([len(s) for s in sets])
    ends = np.cumsum(lengths)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(len(values), bool)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    for a, b in zip(first, np.append(first[1:], len(x)), strict=True):
        own = flat[ends[x[a]] - lengths[x[a]] : ends[x[a]]]
        has[own] = True
        for at in range(a, b, 256):
            others = y[at : min(b, at + 256)]
            hits = has[np.concatenate([flat[ends[k] - lengths[k] : ends[k]] for k in others])]
            edges = np.concatenate(([0], np.cumsum(lengths[others])[:-1]))
            out[at : at + len(others)] = np.add.reduceat(hits, edges, dtype=np.int64)
        has[own] = False
    return out


MEMBERS = "rep long, s1 long, s2 long, n long, others long"
PAIRS = "x long, y long, x_size long, y_size long, x_n long, y_n long"


def _linked_pairs(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of a bucket whose sets link, each pair of a cell once."""
    get = lambda name: t.column(name).to_numpy()
    n, sketches = get("n"), Sketches(t.column("sketch").to_pylist())
    group = _numbered(get("label"), get("one"), get("two"))
    blobs = {name: t.column(name).to_pylist() for name in ("b", "c", "tokens")}
    for a, b in _meetings(group, get("own"), get("one") != get("two"), n, percent):
        keep = sketches.pass_on(a, b, overlap_needed(n[a], n[b], percent))
        a, b = a[keep], b[keep]
        for name in ("b", "c", "tokens"):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            both = _overlaps(at[: len(a)], at[len(a) :], [unpack_sorted(blobs[name][i]) for i in used])
            # orders B and C: a shared prefix token; then whole sets
            keep = both > 0 if name != "tokens" else 100 * both >= percent * (n[a] + n[b] - both)
            a, b = a[keep], b[keep]
        yield a, b


def _count_links(t: pa.Table, percent: int) -> pa.Table:
    """For each set of a bucket's cells, the records of the other sets that link with it there."""
    size, others = t.column("size").to_numpy(), np.zeros(t.num_rows, np.int64)
    for a, b in _linked_pairs(t, percent):
        np.add.at(others, a, size[b])
        np.add.at(others, b, size[a])
    some = t.select(["rep", "s1", "s2", "n"]).append_column("others", pa.array(others))
    return some.filter(pa.array(others > 0))


def _list_links(t: pa.Table, percent: int) -> pa.Table:
    """The linking pairs of a bucket's cells, the lesser id first."""
    rep, size, n = (t.column(k).to_numpy() for k in ("rep", "size", "n"))
    found = [tuple(np.empty(0, np.int64) for _ in range(6))]
    for a, b in _linked_pairs(t, percent):
        turned = rep[a] > rep[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        found.append((rep[a], rep[b], size[a], size[b], n[a], n[b]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=[f.split()[0] for f in PAIRS.split(", ")])


def _met(spark, signs: DataFrame, reps: DataFrame, links: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes with size and component, sets of all members of components dealt to buckets of cells)."""
    sizes = signs.filter("n > 0 and doc_id is not null").select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count("*").alias("size"))
    labelled = written(_labelled(signs, reps, links).select(*KEY, F.col("component").alias("label")), "labelled")
    classes = written(reps.select(*KEY, "rep", "sketch").join(sizes, KEY).join(labelled, KEY, "left"), "sizes")
    # a class is in the sets once for every row that repeats its least id and text: one of them is taken
    whole = sets.withColumnRenamed("doc", "rep").join(classes.filter("label is not null"), [*KEY, "rep"]).dropDuplicates([*KEY, "rep"])
    tiles = classes.filter("label is not null").groupBy("label").agg((F.greatest(F.count("*") / F.lit(TILE), F.sum("n") / F.lit(TILE_TOKENS))).cast("int").alias("more"), F.sum("n").alias("tokens"))
    large = tiles.filter("more > 0").select("label", "more")
    total = tiles.agg(F.sum(F.col("tokens") * (F.col("more") + 1))).first()[0] or 0
    buckets = max(4 * shuffle_width(spark), int(total) // (2 * TILE_TOKENS))
    dealt = _cells(whole, large, "label", "s1").select(F.pmod(F.xxhash64("label", "one", "two"), F.lit(buckets)).alias("bucket"), "label", "one", "two", "own", "rep", *KEY, "size", "sketch", "b", "c", "tokens")
    return classes, dealt, labelled


def linked(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``, the first three as ``join`` has them.

    A record is an id with a set; n_links counts the other records whose set
    links with the row's own, exact copies included.  It is 0 for texts without
    words, and for null ids, which link with nothing.  Exact copies are one set
    with a size.  Different sets of a component are compared pair by pair in
    the workers, so a component's work grows with the square of its distinct
    sets, its rows with the number of its tiles.
    """
    signs, reps, links, sets = _links(docs, width, percent, id_col, text_col)
    classes, dealt, labelled = _met(docs.sparkSession, signs, reps, links, sets)
    counts = written(dealt.groupBy("bucket").applyInArrow(lambda t: _count_links(t, percent), MEMBERS), "link-counts")
    others = counts.groupBy(*KEY).agg(F.sum("others").alias("others"))
    info = classes.join(others, KEY, "left").select(*KEY, F.coalesce("label", "rep").alias("component_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = written(_of_rows(signs, reps, info, "n_links"), "linked")
    discard(signs, reps, links, sets, classes, labelled, counts)
    return out


def link_pairs(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(x, y, x_size, y_size, x_n, y_n): every two different sets that link, once, each named by the
    least id that has it, with the number of ids that have it and its shingles.  Its rows grow with
    the links themselves; ``linked`` only counts them."""
    signs, reps, links, sets = _links(docs, width, percent, id_col, text_col)
    classes, dealt, labelled = _met(docs.sparkSession, signs, reps, links, sets)
    out = written(dealt.groupBy("bucket").applyInArrow(lambda t: _list_links(t, percent), PAIRS), "link-pairs")
    discard(signs, reps, links, sets, classes, labelled)
    return out


#: Ids that are broadcast at most (16 MB); more are joined by a shuffle of the rows.
BROADCAST_IDS = 1_000_000


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component, all columns; null ids stay.

    The ids that go are counted: few enough are broadcast, so that texts are
    not shuffled; beyond that the texts are shuffled once.
    """
    found = join(docs, width, percent)
    gone = written(found.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    discard(found)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def query(spark, sf_dir):
    """The whole join: a row per document with its component and its number of links."""
    return linked(table(spark, sf_dir, "documents"), 3, 90)
