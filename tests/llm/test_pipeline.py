"""The corpus pipeline against plain Python, stage by stage."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import VOCABULARY, best_occurrence, quality_by_hand, shingles, words

import corpus_pipeline
from kindred.llm import decontaminate, quality, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    prose = lambda n, v=VOCABULARY: " ".join(rng.choices(v, k=n))
    rows = [(i, prose(rng.randrange(12, 120))) for i in range(60)]
    near = rows[7][1].split()
    near[3:4] = ["changed"]
    rows += [(70, rows[5][1]), (71, rows[5][1].upper()), (72, " ".join(near)), (73, rows[7][1] + " tail")]
    rows += [(80, "too short"), (81, ""), (82, None), (83, "one two three four five six " * 20), (84, prose(60, [f"junk{i}" for i in range(50)]))]
    item = prose(40)
    rows += [(90, f"{prose(20)} {item} {prose(20)}"), (91, f"{prose(20)} {item.replace('w1', 'v1', 2)}"), (92, f"{prose(30)} <|endoftext|> {prose(10)}"), (None, prose(30)), (None, prose(31)), (20, rows[20][1])]
    source = lambda i: "hot" if i is None or i % 3 == 0 else None if i % 11 == 0 else f"s{i % 4}"
    docs = [(i, t, "en", source(i), len(t or "")) for i, t in rows]
    labels = [(i, 1 if i < 60 else 0, 0) for i in [*range(0, 60, 2), 84]]
    return docs, labels, [(1, item), (2, "not to be found in any of the texts at all")]


def hash60(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)


def one_of_each(rows):
    sets = [shingles(t, 5) for _, t, *_ in rows]
    lead = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                lead[y] = x
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def mixed(rows):
    """Targets by resharing the excess until none is left; then documents by hash up to the room left."""
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(2.0 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        own = [r for r in rows if r[3] == s]
        times = int(target[s] // sizes[s]) if sizes[s] else 0
        room, taken = target[s] - times * sizes[s], set()
        for h in sorted({hash60(r[0]) for r in own}):
            step = sum(len(words(r[1])) for r in own if hash60(r[0]) == h)
            if step > room and not step - room < room:
                break
            taken.add(h)
            room -= step
            if room < 0:
                break
        for r in own:
            out += [r] * min(2, times + (hash60(r[0]) in taken))
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, benchmark = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    verdicts = quality_by_hand([r[:2] for r in docs], labels, quality.THRESHOLD, quality.BUCKET_BITS)
    want = [[r for r, v in zip(docs, verdicts, strict=True) if v[-1]]]
    want.append(one_of_each(want[-1]))
    want.append([r for r in want[-1] if all(best_occurrence(decontaminate.normal(t), decontaminate.normal(r[1]), decontaminate.budget(len(decontaminate.normal(t)))) is None for _, t in benchmark)])
    want.append(mixed(want[-1]))
    assert len(docs) > len(want[0]) > len(want[1]) > len(want[2]) > 40 and len(want[3]) != len(want[2])  # every stage decides something
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, rows.collect()), key=key) == sorted(kept, key=key), name
        rows.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
    library = Tokenizer.from_file(token_store.vocabulary_path())
    ids = sorted((-1 if r[0] is None else r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in want[-1])
    found = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert [(-1 if r[0] is None else r[0]) for r in found] == [i for i, _ in ids]
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in found) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [r[1] for r in found] == [sum(r[2] for r in found[:k]) for k in range(len(found))]
    assert not [n for n, _ in corpus_pipeline.STAGES if not n] and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, empty):
    docs, labels, benchmark = ([] if n == empty else t for n, t in zip(("documents", "labels", "benchmark"), corpus(), strict=True))
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert (found.count() == 0) == (empty == "documents") and found.filter(F.col("n_tokens") < 1).count() == 0
