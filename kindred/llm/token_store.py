"""Token-id output: a content-addressed store of chunks, with document recipes and a Merkle manifest."""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, give_back, mix, shuffle_width, table, writing, written

MODEL = "byte_bpe_50k.json"
END_ID = 2
#: A boundary follows where the rolling hash of the last WINDOW ids has its low AVERAGE_BITS bits zero.
WINDOW, AVERAGE_BITS, LEAST, MOST = 16, 9, 96, 4096
#: Characters of the texts encoded and cut together (one text may be longer), and the length near which one of them is encoded twice.
GROUP_CHARS, COMPARED_CHARS = 1_000_000, 2000
# Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def second_engine(library, path: str):
    """The same merges run by a faster library, or None where it isn't proved that the ids are equal.

    Its ranks are the ids of the file's own vocabulary.  That stands for the
    file's merges if it is plain byte-level BPE whose merges make the ids after
    the 256 bytes in their order; then every vocabulary string is encoded by
    both, and each task compares more of its texts (``Encoder.packed_all``).
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    model, split = kept["model"], kept.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and kept.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain:
        return None
    byte_of = {c: b for b, c in enumerate(_byte_letters())}
    vocabulary = model["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(c not in byte_of for t in vocabulary for c in t) or [vocabulary.get(t) for t in merged] != list(range(256, 256 + len(merged))) or len(vocabulary) != 256 + len(merged):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
    engine = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole = [t for t in (r.decode("utf-8", "ignore") for r in ranks) if t]
    same = [e.ids for e in library.encode_batch_fast(whole, add_special_tokens=False)] == [engine.encode_to_numpy(t, disallowed_special=()).tolist() for t in whole]
    return engine if same else None


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """The library's ids of whole texts, packed.

    A text with the string of an added token goes to the library itself, and so
    does every text where ``second_engine`` is not proved equal.  The others
    are merged by the second engine; of each group of texts the library encodes
    one as well, and a difference is an error.
    """

    def __init__(self, path: str):
        # a task has one core; the library's thread pool spends more on small batches than it saves
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values() if t.content]
        # added tokens may be found in a normalised text, so case does not count here
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.type = np.dtype("<u2") if self.library.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        self.engine = second_engine(self.library, path)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian integers of ``self.type``."""
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """``packed`` of each text."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and (self.engine is None or self.added.search(t))]
        if self.engine is not None:
            sent = set(whole)
            rest = [i for i, t in enumerate(texts) if t and i not in sent]
            for i in rest:
                out[i] = self.engine.encode_to_numpy(texts[i], disallowed_special=()).astype(self.type).tobytes()
            if rest:
                one = min(rest, key=lambda i: abs(len(texts[i]) - COMPARED_CHARS))
                if self._library([texts[one]]) != [out[one]]:
                    raise ValueError(f"the engines differ on {texts[one][:80]!r}")
        for i, ids in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.type).tobytes() for e in found]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_BASE = 0x9E3779B97F4A7C15
#: Ids hashed at a time, and the powers of the base and of its inverse for them.
_BLOCK = 1 << 16
_UP, _DOWN = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_BLOCK - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_MIXED = mix(np.arange(1 << 16, dtype=np.uint64), 21)


def marks(ids: np.ndarray) -> list[int]:
    """Ends of the windows of an id stream whose rolling hash asks for a boundary, ascending."""
    out = []
    for at in range(0, len(ids) - WINDOW + 1, _BLOCK - WINDOW + 1):
        piece = ids[at : at + _BLOCK]
        values = _MIXED[piece] if piece.dtype.itemsize == 2 else mix(piece.astype(np.uint64), 21)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _DOWN[: len(values)], dtype=np.uint64)))
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * _UP[WINDOW - 1 : len(values)]
        out += (np.flatnonzero((rolled >> np.uint64(64 - AVERAGE_BITS)) == 0) + (at + WINDOW)).tolist()
    return out


def cuts(found: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the document at start..stop; LEAST exceeds WINDOW, so no window before it counts."""
    out, at = [], start
    while stop - at > LEAST:
        i = bisect.bisect_left(found, at + LEAST)
        at = min(found[i] if i < len(found) else stop, at + MOST, stop)
        out.append(at)
    if at < stop:
        out.append(stop)
    return out


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of an id stream, by content: the same ids give the same cuts anywhere."""
    return np.array(cuts(marks(ids), 0, len(ids)) or [0])


# --- CRC-32 of a whole from its parts ---------------------------------------------

_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2)[x] modulo the CRC-32 polynomial, bit-reversed, element by element."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(max(len(a), len(b)), np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def _shift(exponent: np.ndarray) -> np.ndarray:
    """x ** exponent, element by element, by squaring."""
    out = np.full(len(exponent), 0x80000000, np.uint32)
    square, left = np.array([0x40000000], np.uint32), exponent.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], np.full(int(odd.sum()), square[0], np.uint32))
        square, left = _times(square, square), left >> np.uint64(1)
    return out


def crc_share(crc: np.ndarray, bytes_after: np.ndarray) -> np.ndarray:
    """What a part with this crc32 adds (by xor) to the crc32 of a whole in which so many bytes follow it."""
    return _times(crc.astype(np.uint32), _shift(bytes_after.astype(np.uint64) * np.uint64(8)))


# --- writing ---------------------------------------------------------------------

_PARTS = pa.schema([("kind", pa.string()), ("hash", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("after", pa.int64()), ("blob", pa.binary())])
PARTS = "kind string, hash binary, row long, doc_id long, seq long, n_ids long, after long, blob binary"


def _encode_parts(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Recipe rows of each document, and each chunk once per task."""
    enc, pack, sent = encoder(path), zstandard.ZstdCompressor(level=1), set()
    end = np.array([end_id], enc.type).tobytes()
    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PARTS, strict=True)], schema=_PARTS)

    width = enc.type.itemsize
    for batch in batches:
        rows, docs, texts = (batch.column(i).to_pylist() for i in (0, 1, 2))
        at = 0
        while at < len(rows):
            some, chars = at, 0
            while some < len(rows) and chars < GROUP_CHARS:
                chars += len(texts[some] or "")
                some += 1
            coded = [data + end for data in enc.packed_all([t or "" for t in texts[at:some]])]
            data = b"".join(coded)
            found, low, held = marks(np.frombuffer(data, enc.type)), 0, []
            for row, doc, own in zip(rows[at:some], docs[at:some], coded, strict=True):
                high, begin = low + len(own) // width, low
                for seq, stop in enumerate(cuts(found, low, high)):
                    body = data[begin * width : stop * width]
                    key = hashlib.blake2b(body, digest_size=16).digest()
                    held.append(("recipe", key, row, doc, seq, stop - begin, high - stop, None))
                    if key not in sent:
                        if len(sent) < 1_000_000:
                            sent.add(key)
                        held.append(("chunk", key, None, None, None, stop - begin, None, pack.compress(body)))
                    begin = stop
                low = high
            yield flush(held)
            at = some


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes rows on, a chunk only the first time its hash comes (rows come sorted by hash)."""
    last = None
    for batch in batches:
        kinds, keys, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for kind, key in zip(kinds, keys, strict=True):
            keep.append(kind == "recipe" or key != last)
            if kind == "chunk":
                last = key
        yield batch.filter(pa.array(keep, pa.bool_()))


def _body(unpack, key: bytes, n: int, blob: bytes | None, kind: np.dtype) -> bytes:
    """The ids of a chunk, checked against its hash and length."""
    if blob is None:
        raise ValueError(f"chunk {key.hex()} is missing")
    body = unpack.decompress(blob)
    if hashlib.blake2b(body, digest_size=16).digest() != key or len(body) != n * kind.itemsize:
        raise ValueError(f"chunk {key.hex()} does not have its hash or length")
    return body


def _leaf():
    """A document's leaf: a hash over its id and the hashes of its chunks in order."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.array_join(F.transform("chunks", lambda c: F.lower(F.hex(c["hash"]))), ",")).cast("binary"), 256)


def _sound():
    """Whether a recipe row is whole: its leaf is that of its chunks, which are gapless and add up to its ids."""
    chunks = F.col("chunks")
    gapless = F.forall(F.transform(chunks, lambda c, i: c["seq"] == i), lambda x: x)
    sums = F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + c["n_ids"])
    # each chunk says how many ids follow it: those of the next one and what follows that
    follow = F.forall(F.transform(chunks, lambda c, i: c["after"] == F.coalesce(F.get(chunks, i + 1)["n_ids"] + F.get(chunks, i + 1)["after"], F.lit(0))), lambda x: x)
    return F.coalesce((F.size(chunks) > 0) & gapless & follow & (sums == F.col("n_ids")) & (F.col("leaf") == _leaf()), F.lit(False))


class Store:
    """A store on disk: ``chunk`` files by hash, ``recipes`` in ascending document order, ``manifest`` and ``root``.

    Whatever is read is verified: leaves from the recipes' chunks, run hashes
    and places from the leaves, the root from the runs, each chunk by its hash.
    """

    def __init__(self, spark: SparkSession, path: str, vocabulary: str | None = None):
        self.spark, self.path, self.vocabulary = spark, path.rstrip("/"), vocabulary or vocabulary_path()

    def write(self, docs: DataFrame, end_id: int = END_ID) -> None:
        vocabulary = self.vocabulary
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        parts = rows.mapInArrow(lambda b: give_back(_encode_parts(b, vocabulary, end_id)), PARTS)
        n = shuffle_width(self.spark)
        # recipes and chunks are dealt by hash in one shuffle; a hot chunk is sent once per task at most,
        # recipe rows of a hot chunk are spread by row
        spread = F.when(F.col("kind") == "chunk", F.lit(0)).otherwise(F.col("row") % 1009 + 1)
        dealt = parts.repartition(n, "hash", spread).sortWithinPartitions("kind", "hash").mapInArrow(_once, PARTS)
        with writing(self.spark):
            dealt.write.partitionBy("kind").option("compression", "none").parquet(f"{self.path}/parts")
        recipes = self._recipes().groupBy("row", "doc_id").agg(F.sum("n_ids").alias("n_ids"), F.sort_array(F.collect_list(F.struct("seq", "hash", "n_ids", "after"))).alias("chunks"))
        ordered = recipes.withColumn("leaf", _leaf()).repartitionByRange(n, "doc_id", "leaf", "row").sortWithinPartitions("doc_id", "leaf", "row")
        placed = ordered.withColumn("place", F.monotonically_increasing_id())
        with writing(self.spark):
            placed.write.option("compression", "zstd").parquet(f"{self.path}/recipes")
        manifest = self._manifest()
        with writing(self.spark):
            manifest.write.parquet(f"{self.path}/manifest")
        self.root().write.parquet(f"{self.path}/root")

    def _recipes(self) -> DataFrame:
        return self.spark.read.schema(PARTS).parquet(f"{self.path}/parts").filter("kind = 'recipe'")

    def _chunks(self) -> DataFrame:
        return self.spark.read.schema(PARTS).parquet(f"{self.path}/parts").filter("kind = 'chunk'").select("hash", "n_ids", "blob")

    def _ordered(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/recipes")

    def _manifest(self) -> DataFrame:
        """Per run of 4096 places: first id position and a hash over its leaves; then one root row."""
        runs = self._ordered().groupBy(F.shiftright("place", 12).alias("run")).agg(F.sum("n_ids").alias("n_ids"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]), ",").cast("binary"), 256).alias("hash"))
        # two steps of prefix sums, by blocks of runs, then within them
        part = F.shiftright("run", 21)
        blocks = runs.groupBy(part.alias("block")).agg(F.sum("n_ids").alias("block_ids"))
        before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        blocks = blocks.select("block", F.coalesce(F.sum("block_ids").over(before), F.lit(0)).alias("base"))
        inner = W.partitionBy("block").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
        return runs.withColumn("block", part).join(blocks, "block").select("run", "n_ids", "hash", (F.col("base") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("start"))

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("run long, n_ids long, hash string, start long").parquet(f"{self.path}/manifest")

    def root(self) -> DataFrame:
        """One row: the Merkle root over the manifest's runs, by blocks of 2**21 places of runs."""
        block = self.manifest().groupBy(F.shiftright("run", 10).alias("b")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "hash"))), lambda x: x["hash"]), ",").cast("binary"), 256).alias("hash"))
        return block.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "hash"))), lambda x: x["hash"]), ",").cast("binary"), 256).alias("root"))

    def verify(self) -> None:
        """Raises where the recipes, the manifest and the root do not agree; chunks are checked as they are read."""
        stored = self.spark.read.schema("root string").parquet(f"{self.path}/root").collect()
        if len(stored) != 1 or stored[0]["root"] != self.root().first()["root"]:
            raise ValueError("the manifest does not have the stored root")
        bad = self._ordered().filter(~_sound()).select("row").limit(5).collect()
        if bad:
            raise ValueError(f"recipes of rows {[r['row'] for r in bad]} do not have their leaves")
        columns = ("n_ids", "hash", "start")
        there = self.manifest().select("run", *(F.col(c).alias(f"m_{c}") for c in columns))
        same = F.lit(True)
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
        bad = self._manifest().join(there, "run", "full").filter(~same).select("run").limit(5).collect()
        if bad:
            raise ValueError(f"runs {[r['run'] for r in bad]} of the recipes do not have their hash in the manifest")

    def _placed_chunks(self) -> DataFrame:
        """A row per chunk of the verified recipes."""
        return self._ordered().select("row", "doc_id", F.explode("chunks").alias("c")).select("row", "doc_id", "c.*")

    def read_chunks(self) -> DataFrame:
        """(hash, n_ids, crc) of every stored chunk, read from its file and checked against its hash."""
        vocabulary = self.vocabulary

        def run(batches):
            kind, unpack = encoder(vocabulary).type, zstandard.ZstdDecompressor()
            for batch in batches:
                crcs = []
                for key, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    body = _body(unpack, key, n, blob, kind)
                    crcs.append(zlib.crc32(np.frombuffer(body, kind).astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["hash", "n_ids", "crc"])

        return self._chunks().mapInArrow(run, "hash binary, n_ids long, crc long")

    def read_documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) from the files, one row per document row."""

        def share(batches):
            for batch in batches:
                row, crc, after = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc_share(crc, after * 4).astype(np.int64))], names=["row", "share"])

        self.verify()
        crcs = self.read_chunks().select("hash", F.col("n_ids").alias("found"), "crc")
        missing = F.raise_error(F.concat(F.lit("chunk missing or of another length: "), F.hex("hash")))
        parts = self._placed_chunks().select("hash", "row", "after", "n_ids").join(crcs, "hash", "left")
        parts = parts.select("row", F.when(F.col("found") == F.col("n_ids"), F.col("crc")).otherwise(missing.cast("long")).alias("crc"), "after")
        whole = parts.mapInArrow(share, "row long, share long").groupBy("row").agg(F.bit_xor("share").alias("ids_crc32"))
        inner = W.partitionBy("run").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
        places = self._ordered().select("row", "doc_id", "n_ids", "place", F.shiftright("place", 12).alias("run")).withColumn("within", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
        placed = places.join(self.manifest().select("run", "start"), "run", "left")
        return placed.join(whole, "row", "left").select("doc_id", (F.col("start") + F.col("within")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")

    def read_ids(self) -> DataFrame:
        """(doc_id, row, ids): every document's ids put together again from its recipe."""
        vocabulary = self.vocabulary

        def join(batches):
            kind, unpack = encoder(vocabulary).type, zstandard.ZstdDecompressor()
            for batch in batches:
                docs, rows, lists = (batch.column(i).to_pylist() for i in (0, 1, 2))
                ids = [np.concatenate([np.frombuffer(_body(unpack, p["hash"], p["n_ids"], p["blob"], kind), kind) for p in parts]).astype(np.int64) for parts in lists]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "row", "ids"])

        self.verify()
        parts = self._placed_chunks().select("row", "doc_id", "seq", "hash", "n_ids").join(self._chunks().select("hash", "blob"), "hash", "left")
        lists = parts.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "hash", "n_ids", "blob"))).alias("parts"))
        return lists.select("doc_id", "row", "parts").mapInArrow(join, "doc_id long, row long, ids array<long>")


def store(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> Store:
    """Writes the ids of every whole text, with the end id, and returns the store.

    Null text counts as empty (its document has the end id alone); repeated
    rows and ids are documents of their own, in the order of their contents'
    hashes; null ids come first; other columns are ignored; an empty table
    gives a store without documents.
    """
    out = Store(docs.sparkSession, path or fresh_path(docs.sparkSession, "tokens"), vocabulary)
    out.write(docs, end_id)
    return out


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from a fresh store."""
    return written(store(docs, vocabulary=vocabulary).read_documents(), "token-rows")


def query(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"))
