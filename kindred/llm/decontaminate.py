"""Benchmark decontamination: pigeonhole pieces found exactly, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Edits allowed per hundred characters of an item, whatever its length.
EDIT_PERCENT = 8
#: Items shorter than this count only where no letter or digit stands next to them, as they may be parts of words.
WORD_CHARS = 48
#: Characters of items in one automaton, and of texts that are searched for one block of items after the other.
BLOCK_CHARS, GROUP_CHARS = 500_000, 16_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, edit_percent: int = EDIT_PERCENT) -> int:
    return n * edit_percent // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): ``k + 1`` pieces; an occurrence with at most k edits keeps one of them whole."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(pattern: str, text: str, anchored: bool = False):
    """Myers' bit-parallel distances: for each end in ``text`` that of ``pattern`` from the best text ending
    there, or, ``anchored``, from the whole text up to there."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, first = full, 0, m, int(anchored)
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp = minus | (full & ~(d0 | plus))
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 | first
        plus = ((hn << 1) | (full & ~(d0 | hp))) & full
        minus = hp & d0 & full
        yield score


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text`` with at most k edits, the first of ties."""
    best = None
    for j, score in enumerate(distances(pattern, text)):
        if score <= k and (best is None or score < best[0]):
            best = score, j + 1
    return best


def as_words(pattern: str, text: str, low: int, high: int, k: int) -> tuple[int, int] | None:
    """As ``myers`` within low..high of ``text``, for occurrences that no letter or digit of the text touches."""
    starts = lambda at: at == 0 or not text[at - 1].isalnum()
    ends = lambda at: at == len(text) or not text[at].isalnum()
    best, turned = None, pattern[::-1]
    for j, score in enumerate(distances(pattern, text[low:high])):
        end = low + j + 1
        if score > k or not ends(end) or (best and score >= best[0]):
            continue
        # from the end back to a beginning: the exact distance of each text that ends here
        back = text[max(0, end - len(pattern) - k) : end][::-1]
        found = [d for i, d in enumerate(distances(turned, back, True)) if d <= k and starts(end - i - 1)]
        if found and (best is None or min(found) < best[0]):
            best = min(found), end
    return best


class Matcher:
    """All occurrences of the items in a text, one automaton over the pieces of all items."""

    def __init__(self, items: list[tuple[int, str]], edit_percent: int = EDIT_PERCENT):
        import ahocorasick

        self.items, self.tree = [], ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = budget(len(text), edit_percent)
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, k))
        for piece, where in found.items():
            self.tree.add_word(piece, (len(piece), where))
        self.empty = not found
        if not self.empty:
            self.tree.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item within its budget."""
        if self.empty or not text:
            return []
        text, best, tried = normal(text), {}, set()
        for end, (size, where) in self.tree.iter(text):
            for i, at in where:
                item_id, item, k = self.items[i]
                start = end + 1 - size - at
                if (i, start) in tried or (i in best and best[i][0] == 0):
                    continue
                tried.add((i, start))
                low, m = max(0, start - k), len(item)
                if m < WORD_CHARS:
                    hit = as_words(item, text, low, max(0, start + m + k), k)
                else:
                    exact = text.find(item, low, max(0, start + m + k))
                    hit = (0, exact + m) if exact >= 0 else None
                    if hit is None and k and (hit := myers(item, text[low : start + m + k], k)):
                        hit = hit[0], low + hit[1]
                if hit and (i not in best or hit < best[i]):
                    best[i] = hit
        return [(self.items[i][0], *hit) for i, hit in best.items()]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """The stated query set in blocks of bounded size, fetched from the cluster block by block.

    An item of more characters than a block has is a block of its own.
    """
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).dropna().dropDuplicates().toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matched(batches, blocks, edit_percent: int):
    """(batch, matches of each of its rows): every block of items is looked for in some texts before the next ones are read."""
    alone = Matcher(blocks[0].value, edit_percent) if len(blocks) == 1 else None

    def search(held):
        found = [[[] for _ in range(b.num_rows)] for b in held]
        for block in blocks:
            matcher = alone or Matcher(block.value, edit_percent)
            for b, rows in zip(held, found, strict=True):
                for i, text in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()):
                    rows[i] += matcher.matches(text)
        yield from zip(held, found, strict=True)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if alone or size >= GROUP_CHARS:
            yield from search(held)
            held, size = [], 0
    yield from search(held)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())])


def find(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """(doc_id, item_id, distance, end) for every item that a document holds within its edit budget.

    Whole texts are searched, lower-cased with white space collapsed; ``end`` is
    in that text.  An item may differ by ``edit_percent`` of its characters, at
    any length; one of fewer than WORD_CHARS counts only where no letter or
    digit of the text touches it.  The best occurrence counts, the first of equal ones.
    Null or empty texts and items match nothing; repeated documents each match,
    repeated items (same id and text) once; other columns are ignored, whatever
    their names.  The texts are read once, for all blocks of items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, end long"
    if not blocks:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch, found in _matched(batches, blocks, edit_percent):
            hits = [(d, *m) for d, ms in zip(batch.column(0).to_pylist(), found, strict=True) for m in ms]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item within its edit budget (see ``find``)."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark)]
    if not blocks:
        return docs

    def run(batches):
        for batch, found in _matched(batches, blocks, edit_percent):
            yield batch.filter(pa.array([not ms for ms in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
