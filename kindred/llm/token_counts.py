"""Token counts with a whole-token shortcut for a SentencePiece vocabulary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Entries of a worker's memo of merged pre-tokens; it starts anew when full.
MEMO = 400_000


def vocabulary_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Exact token counts of a text by counts of its pre-tokens.

    A pre-token is a run without white space, with the one space before it.
    No vocabulary piece holds the word mark after another character (checked
    here), so no merge crosses a mark that a single space between two words
    stands for, and counts add.  A pre-token that the library itself encodes as
    one token is counted without merging; that is proved once per vocabulary by
    encoding every such vocabulary string alone.  Other pre-tokens are merged by
    the library once and remembered.  Texts in which white space is anything
    but single spaces between words and line feeds inside them go to the
    library whole, as do all texts if the vocabulary fails the check.
    """

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo_size = memo
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        plain = [p for i, p in enumerate(pieces) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.additive = not any(MARK in p.lstrip(MARK) for p in plain) and self._keeps_spaces()
        words = [p[1:] for p in plain if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        self.whole = {w: 1 for w, ids in zip(words, self.library.encode(words, num_threads=1), strict=True) if len(ids) == 1} if self.additive else {}
        self.memo: dict[str, int] = dict(self.whole)

    def _keeps_spaces(self) -> bool:
        """Whether the normaliser leaves text alone but for the mark in front and for spaces."""
        probe = "a  b ééﬁ ①\tc"
        got = self.library.encode(probe, out_type=str)
        return self.library.decode(self.library.encode(probe)) == probe and "".join(got).startswith(MARK + "a" + MARK * 2 + "b")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.additive:
            words = text.split(" ")
            memo = self.memo
            try:
                return sum([memo[w] for w in words])
            except KeyError:
                if self._learn(words):
                    return sum([self.memo[w] for w in words])
        return len(self.library.encode(text, num_threads=1))

    def _learn(self, words: list[str]) -> bool:
        memo = self.memo
        new = list({w for w in words if w not in memo})
        if any(not w or w[0].isspace() or w[-1].isspace() or MARK in w or "\0" in w for w in new):
            return False
        if len(memo) + len(new) > self.memo_size + len(self.whole):
            self.memo = memo = dict(self.whole)
            new = list(set(words) - memo.keys())
        memo.update(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
        return True


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process and vocabulary; its memo outlives tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row per row.

    Counts are those of the library's ``encode`` with nothing added and special
    strings as plain text.  Null counts as empty (0 bytes, 0 tokens); repeated
    rows each give a row; other columns are ignored.
    """
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            tokens = [count.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
