"""Operators on small tables with nulls, blanks, repeats, ties, long texts, other columns and no rows."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import chat, decontaminate, fixity, graph, html_text, jaccard, licenses, mixing, quality, token_counts, token_store
from kindred.llm.common import hashed_words, text_buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, hash string"
random.seed(3)
VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choices(VOCABULARY, k=30_000))
BASE = " ".join(random.choices(VOCABULARY, k=120))


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def docs(spark):
    swapped = BASE.split()
    swapped[60] = "other"
    rows = [None, "", "  \t\n", "one", "One", "a b", "a  b c", BASE, BASE.upper(), " ".join(swapped), BASE + " x", LONG, LONG + " tail", "</s> <s> [INST]", "日本 語　テ\nスト", "#$% | a a a a a a a a a a a a"]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], 0, 1, 2, "x") for i, t in enumerate(rows)]
    rows += [(8, BASE.upper(), "en", "a", 0, 1, 2, "x"), (None, BASE, None, None, 0, 1, 2, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def by_hand(rows, k, percent):
    """(component by id, records, links) by comparing all sets."""
    rows = [(d, shingles(t, k)) for d, t in rows]
    lead = {d: d for d, _ in rows if d is not None}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    link = lambda s, t: 100 * len(s & t) >= percent * len(s | t)
    for a, s in rows:
        for b, t in rows:
            if None not in (a, b) and s and t and link(s, t):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return rows, {d: find(d) for d in lead} | {None: None}, {(d, s) for d, s in rows if d is not None and s}, link


def test_jaccard(spark):
    df = docs(spark)
    rows, component, *_ = by_hand(pairs(df), 5, 80)
    assert Counter(tuple(r) for r in jaccard.join(df, 5, 80).collect()) == Counter((d, len(s), component[d]) for d, s in rows)
    assert jaccard.join(none(spark), 5, 80).count() == 0


@pytest.mark.parametrize(("k", "percent", "tile"), [(3, 90, 256), (5, 80, 3)])
def test_jaccard_links(spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TOGETHER", 50)
    monkeypatch.setattr(jaccard, "SALTED", tile)
    near = []
    for i in range(12):  # near copies that mostly link with each other, not only with one of them
        w = BASE.split()
        w[5 + 9 * i] = f"n{i}"
        near.append((100 + i, " ".join(w), "en", "a", 0, 1, 2, "x"))
    # an id with two texts that link with each other only, one with a text and a blank, one with two texts that differ
    twice = [(300, "p q r s t u v w x y z " * 9 + t, *near[0][2:]) for t in ("", "z")] + [(301, t, *near[0][2:]) for t in ("", near[1][1])] + [(302, t, *near[0][2:]) for t in ("lone words here", near[2][1])]
    df = docs(spark).union(spark.createDataFrame([*near, (200, near[0][1], *near[0][2:]), *twice], SCHEMA))
    rows, component, records, link = by_hand(pairs(df), k, percent)
    want = Counter((d, len(s), component[d], 0 if d is None or not s else sum(link(s, t) for _, t in records) - 1) for d, s in rows)
    assert Counter(tuple(r) for r in jaccard.linked(df, k, percent).collect()) == want
    if tile == 256:
        assert jaccard.linked(none(spark), k, percent).count() == 0 == jaccard.link_pairs(none(spark), k, percent).count()
        return
    ids = {}
    for d, s in records:
        ids.setdefault(s, []).append(d)
    sets = sorted(ids, key=lambda s: (min(ids[s]), len(s)))  # of one id, the smaller set comes first
    whole = Counter((min(ids[s]), min(ids[t]), len(ids[s]), len(ids[t]), len(s), len(t)) for i, s in enumerate(sets) for t in sets[i + 1 :] if link(s, t))
    assert Counter(tuple(r) for r in jaccard.link_pairs(df, k, percent).collect()) == whole and len(whole) > 12


def test_sketches_bound_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 60, 500, 2_100, 20_000, 70_000, 300_000)]
    sets += [np.unique(np.concatenate((s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 9 + 1).astype(np.uint64)))) for s in sets]
    sets += [np.zeros(1, np.uint64)]
    kept = jaccard.Sketches([jaccard.sketch(s) for s in sets])
    x, y = (k.ravel() for k in np.meshgrid(range(len(sets)), range(len(sets))))
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert kept.pass_on(x, y, both).all()  # an upper bound, whatever the sizes
    assert jaccard.sketch(np.full(1000, 7, np.uint64)) is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 200)] + [(500, 500), (None, 3), (700, 600), (650, 700), (600, 650)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 201)} | {500: 500, 600: 600, 650: 600, 700: 600}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    df = docs(spark)
    kept = jaccard.one_of_each(df)
    lead = {r["doc_id"]: r["component_id"] for r in jaccard.join(df, 5, 80).collect()}
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(t for t in map(tuple, df.collect()) if t[0] is None or lead[t[0]] == t[0])
    assert jaccard.one_of_each(none(spark)).count() == 0


def test_word_hashing_in_pieces():
    import pyarrow as pa

    from kindred.llm import common

    whole = [h.tolist() for _, h, _ in hashed_words(pa.array([LONG]))][0]
    old, common._PIECE = common._PIECE, 1000
    try:
        assert [h.tolist() for _, h, _ in hashed_words(pa.array([LONG]))][0] == whole
    finally:
        common._PIECE = old
    assert len(whole) == 30_000
    assert text_buffers(pa.array([None, "ab"]).slice(1))[1].tolist()[-1] == 2


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>\\ <</s>s> [INST]"), (2, 0, "assistant", None), (2, 0, "tool|>", "x"), (2, None, None, "<|role a|>"), (None, 3, "system", "s")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    one = "user\nhi\nassistant\n</s>\\ <</s>s> [INST]\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(one.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest() and got[1]["loss_chars"] == len(rows[1][3])
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["n_turns"] == 3 and got[None]["n_turns"] == 1
    two = "\n<|role a|>\nassistant\n\ntool|>\nx\n"
    assert got[2]["turns_sha256"] == hashlib.sha256(two.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_long_and_repeated(spark):
    texts = [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </s> " * (1 + i % 3)) for i in range(3000)]
    texts += [(10, 0, "user", "x" * 2_000_000), (10, 1, "assistant", "[INST]" * 100_000)] + [(11, 0, "user", "same")] * 2 + [(12, 0, "user", "q"), (12, 1, "assistant", "a"), (12, 2, "user", "no answer")]
    df = spark.createDataFrame(texts, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (9, 10, 11, 12):
        own = [(r, t) for c, _, r, t in texts if c == conv]
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv]["loss_chars"] == sum(len(t) for r, t in own if r == "assistant") and got[conv]["n_turns"] == len(own)
    assert [got[c]["valid"] for c in (9, 10, 11, 12)] == [True, True, False, False]
    cut = chat.format_conversations(df.filter("conv_id = 12")).filter("segment < 5")
    with pytest.raises(Exception, match="ends within a turn"):
        chat.read_back(cut).collect()


def test_chat_codec():
    codec = chat.Codec()
    random.seed(1)
    for _ in range(3000):
        t = "".join(random.choice(["<", "s", ">", "/", "\\", "[INST]", "</s>", "<<SYS>>", "|", "<|role ", "<|end|>", "a"]) for _ in range(8))
        e = codec.escape(t)
        assert codec.unescape(e) == t and not codec.controls.search(e)


def test_token_counts(spark):
    df = docs(spark)
    library = token_counts.counter(token_counts.vocabulary_path()).library
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t in pairs(df))
    assert Counter(tuple(r) for r in token_counts.count_tokens(df).collect()) == want
    assert token_counts.count_tokens(none(spark)).count() == 0


def test_token_store(spark):
    df = docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    kept = token_store.store(df)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(kept.vocabulary)
    start, want = 0, {}
    for d, t in sorted(pairs(df)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    got = {r[0]: tuple(r)[1:] for r in kept.read_documents().collect()}
    assert got == {d: v[:3] for d, v in want.items()}
    assert {r["doc_id"]: r["ids"] for r in kept.read_ids().collect()} == {d: v[3] for d, v in want.items()}
    hashes = kept.read_chunks()
    assert hashes.count() == hashes.select("hash").distinct().count()
    assert kept.root().count() == 1
    assert token_store.encode_documents(docs(spark)).count() == docs(spark).count()
    assert token_store.encode_documents(none(spark)).count() == 0


def test_token_store_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "x y"), (3, "b c"), (3, "a"), (3, "a"), (None, None), (1, "")], "doc_id long, text string")
    rows = sorted(map(tuple, token_store.encode_documents(df).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, None, 1, 3, 3, 3]  # null ids come first, then ids ascending
    assert [r[1] for r in rows] == [sum(r[2] for r in rows[:i]) for i in range(6)]
    assert Counter((r[0], r[2]) for r in rows) == Counter([(None, 3), (None, 1), (1, 1), (3, 3), (3, 2), (3, 2)])


def test_token_engines_agree():
    from tokenizers import Tokenizer

    path = token_store.vocabulary_path()
    fresh, enc = Tokenizer.from_file(path), token_store.Encoder(path)
    assert enc.engine is not None
    rng = random.Random(11)
    alphabet = [c for c in map(chr, (rng.randrange(0x110000) for _ in range(400))) if not 0xD800 <= ord(c) < 0xE000]
    alphabet += [*" \n\t\r\x0b\x0c\x85\xa0\u2003\u200b'sdmtrevl0123456789abcdefghij.,;:!?()#@éüß日本語😀क्षि", "<|endoftext|>", " the", "ing", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)] + ["a" * 50_000, " " * 50_000, "ab " * 20_000]
    want = [np.array(e.ids, enc.type).tobytes() for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [enc.packed(t) for t in texts] == want == enc.packed_all(texts)
    one = "a{0}b a {0}b {0}{0}1 {0} {0}  x"
    every = [one.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0)]
    enc.engine, whole = None, enc.packed_all(every)  # evaluated before the engine goes
    assert enc.packed_all(every) == whole


def test_token_store_added_tokens(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(token_store.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a <|ENDOFTEXT|> b", "plain words", "<|endoftext|> <|endoftext|>\n", "a <|endof text|> b"]
    texts += [f"w {t.content} w" for t in fresh.get_added_tokens_decoder().values()]
    assert fresh.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start, want = 0, {}
    for d, t in enumerate(texts):
        ids = [*fresh.encode(t, add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in token_store.encode_documents(df).collect()} == want


def test_token_store_tampered(spark, tmp_path):
    import glob
    import os
    import shutil

    df = docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    whole = token_store.store(df, str(tmp_path / "whole"))
    before = whole.read_documents().count()
    assert before == df.count() == whole.read_ids().count()

    def changed(name, change):
        path = str(tmp_path / name)
        shutil.copytree(whole.path, path)
        change(path)
        kept = token_store.Store(spark, path)
        for read in (kept.read_documents, kept.read_ids):
            with pytest.raises(Exception, match="(?i)chunk|leaves|hash|root"):  # noqa: B017, PT011
                read().collect()

    def lose(pattern):
        return lambda path: [os.remove(f) for f in sorted(glob.glob(f"{path}/{pattern}"), key=os.path.getsize)[-1:]]

    def rewrite(table, fn):
        def change(path):
            rows = fn(spark.read.parquet(f"{path}/{table}")).toArrow()
            shutil.rmtree(f"{path}/{table}")
            spark.createDataFrame(rows).write.parquet(f"{path}/{table}")

        return change

    changed("chunks", lose("parts/kind=chunk/*.parquet"))
    changed("recipes", lose("recipes/*.parquet"))
    changed("manifest", lose("manifest/*.parquet"))
    changed("root", lose("root/*.parquet"))
    changed("cut", rewrite("recipes", lambda d: d.withColumn("chunks", F.slice("chunks", 1, F.greatest(F.lit(1), F.size("chunks") - 1)))))
    changed("ids", rewrite("recipes", lambda d: d.withColumn("n_ids", F.col("n_ids") + 1)))
    changed("start", rewrite("manifest", lambda d: d.withColumn("start", F.col("start") + 1)))
    changed("run", rewrite("manifest", lambda d: d.withColumn("hash", F.reverse("hash"))))


def quality_by_hand(rows, labels, threshold, bits):
    """(base counts, base_failed, ratio, kept) of each text, in plain Python."""
    import math

    import xxhash

    def grams(t):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(t)]
        return [x % (1 << bits) for x in h] + [xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest() % (1 << bits) for a, b in zip(h, h[1:], strict=False)]

    trusted = {d for d, q, x in labels if q == 1 and x == 0 and d is not None}
    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for d, t in rows if d in trusted for g in grams(t))
    n, m = sum(raw.values()), sum(target.values())
    logs = {g: math.log((target[g] + quality.PRIOR * raw[g] / n) / (m + quality.PRIOR)) - math.log(raw[g] / n) for g in raw}
    for d, t in rows:
        w = words(t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(windows)
        again = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        own = grams(t)
        ratio = sum(logs[g] for g in own) / len(own) if own else 0.0
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        yield d, t, counts, failed, ratio, not failed and ratio >= threshold


def test_quality(spark):
    rng = random.Random(4)
    good, bad = VOCABULARY[:200], VOCABULARY[150:]
    more = [(100 + i, " ".join(rng.choices(good if i % 2 else bad, k=rng.randrange(5, 90)))) for i in range(60)]
    df = docs(spark).union(spark.createDataFrame([(*r, "en", "a", 0, 1, 2, "x") for r in more], SCHEMA))
    marks = [(7, 1, 0), (9, 1, 0), (15, 0, 0), (None, 1, 0), (8, 1, 1)] + [(100 + i, i % 2, 0) for i in range(40)] + [(101, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for threshold in (-0.1, -0.001, 0.002):
        want = list(quality_by_hand(pairs(df), marks, threshold, quality.BUCKET_BITS))
        got = quality.assess(df, labels, threshold).collect()
        columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert Counter((r["doc_id"], r["text"], tuple(r[c] for c in columns), r["base_failed"], round(r["llr"], 9), r["kept"]) for r in got) == Counter((d, t, c, f, round(x, 9), k) for d, t, c, f, x, k in want)
    kept = Counter(k for *_, k in want)
    assert min(kept.values()) > 10  # both verdicts occur
    assert quality.assess(none(spark), labels).count() == 0
    assert not any(r["base_failed"] != (not r["kept"]) for r in quality.assess(df, labels.limit(0)).collect())  # without trusted documents


def test_clashing_names(spark):
    """Operators that return the caller's columns do so whatever the names."""
    names = ["doc_id", "text", "source", "_words", "_hashes", "_logs", "_windows", "_lines", "_buckets", "_counts", "kept", "n_words", "_s", "s", "times", "below", "_n", "_copy", "n", "row", "hash", "key", "copy", "component_id", "doc", "sketch", "_good", "_id"]
    rows = [(i, f"{BASE} {i} {LONG[: 40 * i]}", "a", *(f"{c}{i}" for c in names[3:])) for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string")
    passed = quality.passing(df, labels, -9.0)
    assert passed.columns == names and sorted(map(tuple, passed.collect())) == sorted(rows)
    assert set(quality.assess(df, labels).columns) == {*names, *quality.OUTPUT}
    for out in (mixing.mixed(df), jaccard.one_of_each(df), decontaminate.clean(df, benchmark)):
        assert out.columns == names and {tuple(r) for r in out.collect()} <= set(rows)


def test_quality_ratio(spark):
    import math

    import xxhash

    df = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, "a c")], "doc_id long, text string")
    signed = lambda b, seed=42: xxhash.xxh64(b, seed=seed).intdigest()

    def grams(t):
        h = [signed(w.encode()) for w in t.split()]
        return [x % 64 for x in h] + [signed(b.to_bytes(8, "little"), signed(a.to_bytes(8, "little"))) % 64 for a, b in zip(h, h[1:], strict=False)]

    raw, target = Counter(g for t in ("a b a", "c d", "a c") for g in grams(t)), Counter(grams("a b a"))
    n, m = sum(raw.values()), sum(target.values())
    row = quality.ratios(df, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"), 6).first()[0]
    for g in raw:
        want = math.log((target[g] + quality.PRIOR * raw[g] / n) / (m + quality.PRIOR)) - math.log(raw[g] / n)
        assert row[g] == pytest.approx(want, abs=1e-12)


def best_occurrence(item, text, k):
    """The least distance of ``item`` from a part of ``text``, by the textbook table; short items touch no letter or digit."""
    free = len(item) >= decontaminate.WORD_CHARS
    best = None
    for start in range(len(text) + 1) if not free else [0]:
        if not free and start and text[start - 1].isalnum():
            continue
        row = list(range(len(item) + 1))
        for end in range(start, len(text) + 1):
            if end > start:
                new = [0 if free else row[0] + 1]
                for i, p in enumerate(item):
                    new.append(min(row[i] + (p != text[end - 1]), row[i + 1] + 1, new[-1] + 1))
                row = new
            if row[-1] <= k and (best is None or row[-1] < best) and (free or end == len(text) or not text[end].isalnum()):
                best = row[-1]
            if not free and end - start > len(item) + k:
                break
    return best


@pytest.mark.parametrize("n", [1, 2, 10, 12, 13, 20, 25, 38, 47, 48, 60, 81, 100, 150, 300])
def test_decontamination_of_any_length(n):
    rng = random.Random(n)
    for _ in range(12 if n < 100 else 4):
        item = decontaminate.normal("".join(rng.choices("abcde fgh", k=3 * n)))[:n].strip()
        if not item:
            continue
        k = decontaminate.budget(len(item))
        assert k == 8 * len(item) // 100
        for edits in {0, k, k + 1}:
            held = list(item)
            for _ in range(edits):
                i = rng.randrange(len(held) + 1)
                rng.choice([lambda i=i: held.insert(i, "x"), lambda i=i: held.__setitem__(slice(i, i + 1), ["y"]), lambda i=i: held.__delitem__(slice(i, i + 1))])()
            text = decontaminate.normal(f"{''.join(rng.choices('abc d', k=9))}{rng.choice([' ', '(', ''])}{''.join(held)}{rng.choice([' ', '.', 's'])}{''.join(rng.choices('abc d', k=9))}")
            got = decontaminate.Matcher([(1, item)]).matches(text)
            assert (got[0][1] if got else None) == best_occurrence(item, text, k), (item, text)


def test_decontamination(spark, monkeypatch):
    item = " ".join(VOCABULARY[:40])
    edited = item.replace("w17", "v17").replace("w30 ", "")
    rows = [(1, f"x {item.upper()}\n y"), (2, f"{LONG} {edited} end"), (3, "clean text " * 30), (4, None), (5, ""), (6, "ab"), (7, "the short one here"), (1, f"x {item} y"), (None, f"{item} {BASE}")]
    benchmark = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "short one"), (13, "short one"), (14, BASE)], "item_id long, text string")
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, item_id string, distance int")
    want = Counter()
    for d, t in rows:
        for i, x in ((10, item), (13, "short one"), (14, BASE)):
            n = best_occurrence(x, decontaminate.normal(t), decontaminate.budget(len(x)))
            if n is not None:
                want[(d, i, n)] += 1
    assert want[(2, 10, 5)] == 1 and want[(None, 14, 0)] == 1
    for size in (500_000, 1):  # one block of items, and one for each
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        monkeypatch.setattr(decontaminate, "GROUP_CHARS", 1000)
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find(df, benchmark).collect()) == want
        kept = decontaminate.clean(df, benchmark)
        assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6} and kept.columns == df.columns
        assert decontaminate.find(df.limit(0), benchmark).count() == 0
        assert decontaminate.clean(df, benchmark.limit(0)).count() == len(rows)


def test_decontamination_of_short_items():
    found = decontaminate.Matcher([(1, "what is the capital of france")]).matches
    for text in ("So what is the capital of France?", "'What is the capital of France'", "(what is the capital of france)", "what is the capital of france", "what was the capital of france"):
        assert [r[0] for r in found(text)] == [1]
    assert found("somewhat is the capital of francesca") == []  # too many edits to whole words
    assert decontaminate.Matcher([(1, "paris")]).matches("comparison of parish") == [] and decontaminate.Matcher([(1, "paris")]).matches("in paris.") == [(1, 0, 8)]


def test_decontamination_budget():
    assert all(decontaminate.budget(n) == 8 * n // 100 for n in range(400))
    assert min(len(p) for n in range(1, 400) for _, p in decontaminate.pieces("x" * n, decontaminate.budget(n)) if n > 5) >= 6
    item = "the capital of the old kingdom was moved to the river twice"  # 59 characters
    assert decontaminate.Matcher([(1, item)]).matches(item.replace("river", "rapid"))[0][:2] == (1, 4)


#: Notices in wordings that the templates don't have, and their families.
LICENSE_NOTICES = [
    ("This package may be used under the terms of the MIT License, see LICENSE.txt", "MIT"),
    ("foo.js is MIT licensed, as found in the LICENSE file.", "MIT"),
    ("The code in this directory is covered by the MIT license", "MIT"),
    ("to deal in the software without restriction, including without limitation the rights to use, copy, modify", "MIT"),
    ("obtaining a copy of this software and associated", "MIT"),
    ("Use of this source code is governed by an MIT-style license, the MIT license, in the root folder", "MIT"),
    ("in compliance with the Apache 2.0 terms", "Apache-2.0"),
    ("All files are made available under the Apache License Version 2.0", "Apache-2.0"),
    ("Dual use is allowed if the Apache License 2.0 is kept with the files", "Apache-2.0"),
    ("you may not use this file except in compliance with the License", "Apache-2.0"),
    ("distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind", "Apache-2.0"),
    ("You can use it under GPL-2.0-or-later.", "GPL"),
    ("This plugin is free software, you can redistribute it and or modify it under the terms of the GNU General Public License, version 2", "GPL"),
    ("See the GNU General Public License for more details.", "GPL"),
    ("the scripts come under the GNU GPL", "GPL"),
    ("our fork stays under the GNU General Public License", "GPL"),
    ("The bindings are under the GNU Lesser General Public License", "LGPL"),
    ("linked against a library under LGPL-2.1-only", "LGPL"),
    ("under the terms of the GNU Lesser General Public License, version 2.1, as published", "LGPL"),
    ("the server is under the GNU Affero General Public License", "AGPL"),
    ("Affero GPL", "AGPL"),
    ("it was moved to AGPL-3.0-or-later last year", "AGPL"),
    ("use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "BSD"),
    ("The driver is under the BSD 3-Clause terms", "BSD"),
    ("Redistributions in binary form must reproduce the above copyright notice", "BSD"),
    ("may be used to endorse or promote products derived from this software", "BSD"),
    ("Code: BSD 3-Clause", "BSD"),
    ("permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "ISC"),
    ("the author disclaims all warranties with regard to this software", "ISC"),
    ("The tool is under the ISC license", "ISC"),
    ("the parser is covered by the Mozilla Public License", "MPL-2.0"),
    ("you may get the sources under MPL 2.0", "MPL-2.0"),
    ("is made available under the terms of the Eclipse Public License", "EPL"),
    ("this plugin uses EPL-2.0", "EPL"),
    ("Use, modification and distribution are subject to the Boost Software License", "Boost"),
    ("the Boost Software License covers the headers", "Boost"),
    ("this is free and unencumbered software, released into the public domain by its authors", "Unlicense"),
    ("the author or authors of this software dedicate any and all copyright interest", "Unlicense"),
    ("the author has waived all copyright and related rights to the photographs", "CC0"),
    ("the data set is published as CC0 1.0 Universal", "CC0"),
    ("photos: Creative Commons Attribution-NonCommercial, see the site", "CC-BY-NC"),
    ("the slides are CC BY-NC 4.0", "CC-BY-NC"),
    ("maps under CC BY-SA 3.0 by the survey", "CC-BY"),
    ("This text is CC BY-SA 4.0", "CC-BY"),
    ("no part of this publication may be reproduced in any form", "proprietary"),
    ("2019 the Ring Road Press, all rights reserved", "proprietary"),
]
#: Sentences that share words with notices and license nothing.
NO_LICENSES = [
    "the license", "Licensed under", "the License at", "The weather of the day under the sun", "the general public of the city read the terms of the contract", "The license plate of the car",
    "He was licensed under the old law to sell fish", "The apache chief rode to the north", "An eclipse was visible to the general public in August", "We had permission to use the copy machine in the hall",
    "MIT is a university in Cambridge and it has a museum", "This file is about the history of the town and its people", "The software is used by many people and it is free", "a copy of the book was found in the library",
    "The conditions of the road were met with a warning", "She reserved all the seats in the first row", "The law of copyright is old and it is hard to read", "Permission to land was given by the tower",
    "the source of the water is in the hills", "Under the bridge there is a place to sleep", "Version 2.0 of the program runs on the new machine", "The foundation gave the money to the school", "the name of the holder is written on the back of the card",
    "in the documentation you can find the list of materials", "the warranty of the car ends in May", "It is distributed in the hope of peace and of better times for all", "mozilla and boost and eclipse are words", "the public library has a license to lend films",
    "The king waived all the debts of the farmers", "the rights to the song were sold to a bank", "for any purpose you like, with or without milk", "any person who finds a copy may keep it",
]


def test_licenses(spark):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "The license plate of the car"), (1, "Licensed under CC BY-NC 4.0."), (None, "Eclipse Public License v2.0")]
    df = spark.createDataFrame([(*r, "q", 0, "w") for r in rows], "doc_id long, text string, family string, paragraph int, words string")
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(df).collect()}
    assert got == {(1, 1, "MIT"), (2, 0, "GPL"), (5, 0, "unknown"), (1, 0, "CC-BY-NC"), (None, 0, "EPL")}
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_without_anchors(spark, monkeypatch):
    notices = {
        "Distributed under GNU GPL v3": "GPL", "This text is CC BY-SA 4.0": "CC-BY", "Code: BSD 3-Clause": "BSD", "Released under Apache-2.0": "Apache-2.0", "Released under MIT": "MIT",
        "obtaining a copy of this software and associated": "MIT", "The weather of the day under the sun": None, "the general public of the city read the terms of the contract": None,
    }
    assert not any(re.search(licenses.ANCHORS, t.lower()) for t in notices)
    rows = list(enumerate(notices))
    long = " ".join(random.Random(5).choices(VOCABULARY, k=80))
    more = [" ".join([*long.split()[:i], t, *long.split()[i:j]]) + "." for ts in licenses.TEMPLATES.values() for t in ts for i, j in ((0, 0), (9, 30), (40, 80))]
    rows += [(100, "\n".join(more)), (101, "under the " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(df).collect()))
    assert {(d, f) for d, _, f, _, _ in got if d < 100} == {(i, f) for i, f in enumerate(notices.values()) if f}
    # the first look loses nothing that the model names
    monkeypatch.setattr(licenses, "gate", lambda: [1.0] * (1 << licenses.GATE_BITS))
    assert sorted(map(tuple, licenses.scan(df).collect())) == got


def test_licenses_held_out():
    named = [(f, g) for (_, f), (g, _, _) in zip(LICENSE_NOTICES, licenses.classify([t for t, _ in LICENSE_NOTICES]), strict=True)]
    right, found = sum(f == g for f, g in named), [g for _, g in named if g != licenses.UNKNOWN]
    false = [t for t, (g, _, _) in zip(NO_LICENSES, licenses.classify(NO_LICENSES), strict=True) if g != licenses.UNKNOWN]
    assert right / len(named) >= 0.9 and right / (len(found) + len(false)) >= 0.9
    plain = {t.lower() for ts in licenses.TEMPLATES.values() for t in ts}
    assert sum(t.lower() in plain for t, _ in LICENSE_NOTICES) <= 4  # other wordings, but for a few names


def test_licenses_native_scorer_is_the_model(spark):
    rng = random.Random(9)
    words = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in re.findall("[a-z0-9]+", t.lower())})
    texts = [t for t, _ in LICENSE_NOTICES] + NO_LICENSES + [" ".join(rng.choices([*words, *VOCABULARY[:200]], k=rng.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, f"license {t}") for i, t in enumerate(texts)], "doc_id long, text string")  # an anchor, so that every row is listed
    want = licenses.classify([f"license {t}" for t in texts])
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, (family, p, confirmed) in enumerate(want):
        assert (got[i]["family"], got[i]["confirmed"]) == (family, confirmed) and got[i]["probability"] == pytest.approx(p, abs=2e-6)


def test_licenses_calibrated():
    """Of examples made with another seed, about as many are right as the probabilities say, and the unknown ones stay so."""
    texts, labels, families = licenses._examples(seed=77)
    got = licenses.classify(texts)
    shares = []
    for low, high in ((0.25, 0.6), (0.6, 0.9), (0.9, 1.01)):
        some = [(families[k] == f, p) for k, (f, p, _) in zip(labels, got, strict=True) if low <= p < high and f != licenses.UNKNOWN]
        shares.append((sum(r for r, _ in some) / max(1, len(some)), len(some)))
    assert shares[2][0] > 0.95 and all(share > low for (share, n), low in zip(shares, (0.25, 0.6, 0.9), strict=True) if n > 20)
    none = [f for k, (f, _, _) in zip(labels, got, strict=True) if families[k] == licenses.UNKNOWN]
    assert sum(f != licenses.UNKNOWN for f in none) <= 0.02 * len(none)


def test_licenses_of_wrapped_and_long_texts(spark):
    mit, warranty = licenses.TEMPLATES["MIT"][-3], licenses.TEMPLATES["MIT"][-1]
    wrapped = lambda t, n, head="": "\n".join(head + x for x in textwrap.wrap(t, n))
    rows = [
        (1, wrapped(mit, 70)), (2, wrapped(mit, 62, " * ")), (3, "Copyright 2020 Someone\n\n" + wrapped(warranty, 75, "# ")), (4, wrapped(mit, 70).replace("\n", "\r\n")),
        (5, f"{LONG}. {mit} {LONG}"), (6, "/*\n" + wrapped(licenses.TEMPLATES["ISC"][-2], 60, "   ") + "\n*/"), (7, "A title\nReleased under the MIT License\nA line"),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["family"])
    assert [got[i].count("MIT") for i in (1, 2, 3, 4, 5, 7)] == [1] * 6 and got[6] == ["ISC"]


#: Pages written by hand, in layouts that the training pages don't have, and their main texts.
LAYOUTS = {
    "blog": ("""<!doctype html><html><head><title>My blog</title><link rel=stylesheet href=a.css></head><body class="home blog"><div id="wrapper"><header id="masthead" role="banner"><div class="site-branding"><a href="/">Walking in the hills</a></div>
<nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About me</a></li></ul></nav></header>
<main id="main"><article id="post-12" class="post type-post"><h1 class="entry-title">Three days on the ridge</h1><div class="entry-content"><p>We left the car at the bridge and walked up through the pines, which took two hours.</p><p>The hut was <em>full</em>, so we slept outside &amp; saw the stars.</p><blockquote>Never again, she said.</blockquote></div></article>
<section id="comments" class="comments-area"><h2>2 replies</h2><ol class="comment-list"><li class="comment"><p>Lovely pictures, thank you for sharing them with us.</p></li></ol></section></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Archives</h2><ul><li><a href="/2020">2020</a></li></ul></section></aside>
<footer class="site-footer"><p>Copyright 2020. All rights reserved.</p></footer></div><script>var x = "<p>no</p>";</script></body></html>""",
        "Three days on the ridge We left the car at the bridge and walked up through the pines, which took two hours. The hut was full, so we slept outside & saw the stars. Never again, she said."),
    "news": ("""<html><body><div class="topbar"><a href=/>Daily News</a><form class="search"><input name=q><button>Search</button></form></div><div class="cookie-consent"><p>We use cookies to make this site better for you. By going on you agree to that.</p><button>Accept</button></div>
<div class="container"><div class="story-body"><h1>Council votes for the new library</h1><p>The council voted on Tuesday for a new library in the old market hall, after two years of talks.<p>It will open in spring, the mayor said, if the roof is mended by then.<div class="ad-banner"><p>Buy two pairs of shoes and get one more for free, this week only.</p></div><p>The old library closes in March.</div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Bridge closed again</a><li><a href=2>School wins a prize</a></ul></div></div><div class="footer">Daily News, 1 High Street</div></body></html>""",
        "Council votes for the new library The council voted on Tuesday for a new library in the old market hall, after two years of talks. It will open in spring, the mayor said, if the roof is mended by then. The old library closes in March."),
    "plain": ("""<html><head><title>x</title></head><body><h1>Notes on tides</h1>The sea rises twice a day.<br>It falls twice a day, too.<p>Nobody in the village was surprised by that, and nobody wrote it down before me.</p></body></html>""",
        "Notes on tides The sea rises twice a day. It falls twice a day, too. Nobody in the village was surprised by that, and nobody wrote it down before me."),
    "table": ("""<html><body><table width=100%><tr><td colspan=2><div class="header"><a href=/>Old Engines Club</a></div></td></tr><tr><td><div class="menu"><ul><li><a href=a>Start</a></li><li><a href=b>Events</a></li><li><a href=c>Links</a></li></ul></div></td><td><h2>The engine of 1911</h2><p>It was built in a barn by two brothers, and it ran for forty years without a repair.</p><p>Today it stands in our hall.</p></td></tr></table><div class="footer">Club office, open on Mondays.</div></body></html>""",
        "The engine of 1911 It was built in a barn by two brothers, and it ran for forty years without a repair. Today it stands in our hall."),
    "no end tags": ("""<body><nav><ul><li><a href=1>One<li><a href=2>Two</ul></nav><article><h1>On bread</h1><p>Flour, water, salt and time are all that it needs, my grandmother said.<p>She was right about <b>most things</b>, this one too.<ul><li>Mix the flour and the water.<li>Wait until tomorrow morning.</ul></article><footer>&copy; the baker""",
        "On bread Flour, water, salt and time are all that it needs, my grandmother said. She was right about most things, this one too. Mix the flour and the water. Wait until tomorrow morning."),
    "deep": ("<html><body>" + "<div>" * 5000 + "<p>A text far down, which is all that this page has to say to anyone.</p>" + "</div>" * 5000 + "</body></html>", "A text far down, which is all that this page has to say to anyone."),
}


def test_html_held_out():
    fitted = html_text.model()
    rng = np.random.default_rng(1234)
    right = 0
    for _ in range(60):
        page, said = html_text.training_page(rng)
        right += html_text.extract([page], fitted)[0] == " ".join(" ".join(t.split()) for t, keep in said if keep)
    assert right >= 58  # held-out pages, whole texts equal


@pytest.mark.parametrize("name", LAYOUTS)
def test_html_layouts(name):
    page, want = LAYOUTS[name]
    assert html_text.extract([page], html_text.model()) == [want]


def test_html_of_any_kind():
    fitted = html_text.model()
    got = html_text.extract([None, "", "<", "</p>", "<p", "<script>x", "a < b and c", "<p>one<p>two &lt;b&gt; three", "\u0130<SCRIPT>\u0130</SCRIPT>x", "<!-- no", "<br/>"], fitted)
    assert got == ["", "", "<", "", "", "", "a < b and c", "one two <b> three", "\u0130x", "", ""]


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a " > " ' * 100_000, "<div>" * 100_000, "<b>" * 70_000 + "<p>x</p>" * 40_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><button>" + "<b>" * 90_000 + "<h1></h1>" * 40_000, "<" * 900_000, "<!--" * 200_000, "&" * 900_000, "<table><tr><td>" * 50_000, "<title>" * 100_000, "<a class='" * 90_000])
def test_html_takes_linear_time(page):
    import time

    began = time.process_time()
    html_text.blocks(nodes := html_text.parse(page), [True] * len(nodes.tag))
    assert time.process_time() - began < 4  # about a second; a quadratic step would take many minutes


def test_html_learns_names():
    odds = html_text.model()[1]
    assert min(odds[t] for t in ("article", "entry", "story")) > 0 > max(odds[t] for t in ("sidebar", "advert", "comments", "footer", "cookie", "nav"))


def test_html_table(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav><article><h1>A title</h1><p>One &amp; two, three words and more of them.<br>Next line\n here.<p>Second <b>bo</b>ld paragraph of the text, with a stop.</article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (2, None, "", "t")], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["text"]) for r in html_text.main_text(df).collect()}
    assert got == {(1, "A title One & two, three words and more of them. Next line here. Second bold paragraph of the text, with a stop."), (2, "")}


def audited(ours, theirs):
    """Statuses by brute force: equal records of a key meet copy by copy, then as many as both have left are corrupt."""
    out = Counter()
    for key in {r[0] for r in ours + theirs}:
        a, b = (Counter(r[1:] for r in rows if r[0] == key) for rows in (ours, theirs))
        left, other = sorted((a - b).elements(), key=lambda r: r[1]), sorted((b - a).elements(), key=lambda r: r[1])
        both = min(len(left), len(other))
        for r in (a & b).elements():
            out[(key, *r, "ok")] += 1
        for i, r in enumerate(left):
            out[(key, *r, "corrupt" if i < both else "missing")] += 1
        for r in other[both:]:
            out[(key, *r, "extra")] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_fixity(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(fixity, "LIST_ROWS", 2)
        monkeypatch.setattr(fixity, "COPIES", 3)
    rows = [(i, f"u{i}", f"body {i}" * (i % 7)) for i in range(200)]
    rows += [(5, "u5", "again")] * 3 + [(6, "u6", f"version {i}") for i in range(30)] + [(None, None, None), (None, "n", "x"), (None, "n", "x"), (-1, "m", "real"), (-1, None, "real"), (8, "e", ""), (8, "e", None)]
    ours = spark.createDataFrame(rows, "page_id long, url string, html string")
    changed = [(77, "u77", "rot") if r[0] == 77 else r for r in rows if r[0] != 100]
    changed.remove((5, "u5", "again"))  # one copy of three is lost: the others match
    changed = [r for r in changed if r != (6, "u6", "version 3")] + [(6, "u6", f"other {i}") for i in range(3)] + [(9999, "n", "x"), (9999, "n", "x"), (None, "n", "x"), (-5, "low", "x")]
    theirs = spark.createDataFrame(changed, ours.schema)
    leaf = lambda df: fixity.leaves(df, "page_id", fixity.warc_record(F.col("url"), F.col("html")))
    plain = lambda df: [tuple(r) for r in leaf(df).select("id", "n_bytes", "digest").collect()]
    got = fixity.audit(leaf(ours), leaf(theirs)).collect()
    assert Counter((r["id"], r["n_bytes"], r["digest"], r["status"]) for r in got) == audited(plain(ours), plain(theirs))
    assert Counter(r["status"] for r in got if r["id"] == 5) == {"ok": 3, "missing": 1}
    placed = sorted((r["offset"], r["n_bytes"], -1e9 if r["id"] is None else r["id"], r["digest"]) for r in got if r["offset"] is not None)
    assert placed[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(placed, placed[1:], strict=False)) and len(placed) == len(rows)
    assert [r[2:] for r in placed] == sorted(r[2:] for r in placed)  # in (key, digest) order, null ids first
    wrong = {(r["id"], r["offset"]) for r in got if r["status"] in ("corrupt", "missing")}
    ranges = fixity.differing_ranges(leaf(ours), leaf(theirs)).collect()
    assert all(any(r["offset"] is not None and r["offset"] <= at < r["offset"] + r["n_bytes"] for r in ranges) for _, at in wrong)
    assert sum(r["n_bytes"] or 0 for r in ranges) < sum(r[1] for r in placed)  # the rest is not looked at
    assert fixity.audit(leaf(ours.limit(0)), leaf(ours.limit(0))).count() == 0 == fixity.differing_ranges(leaf(ours), leaf(ours)).count()
    assert {r["status"] for r in fixity.audit(leaf(ours), leaf(ours.limit(0))).collect()} == {"missing"}


def test_fixity_commits_to_every_repeat(spark):
    """Three repeats with equal least and greatest digests give different roots, whatever the third is."""
    root = lambda bodies: fixity.tree(fixity.items(fixity.leaves(spark.createDataFrame([(1, b) for b in bodies], "k long, html string"), "k", F.col("html")), 1), 1, 0, 100)[-1].first()["hash"]
    order = sorted("abcdef", key=lambda b: hashlib.sha256(b.encode()).hexdigest())
    seen = {root(x) for x in ([order[0], m, order[-1]] for m in order[1:-1])} | {root([order[0], order[1], order[1], order[-1]])}
    assert len(seen) == 5 and root(order) == root(order[::-1])


def test_warc_files(spark, tmp_path):
    rows = [(1, "http://a/1", "one\r\n\r\nWARC/1.0\r\n\r\ntwo"), (2, None, None), (3, "http://a/3", "\u00e9\u65e5" * 10), (4, "u", "x" * 100_000)]
    df = spark.createDataFrame(rows, "id long, url string, html string").withColumn("record", fixity.warc_record(F.col("url"), F.col("html"), F.concat(F.lit("urn:id:"), F.col("id").cast("string")), F.timestamp_seconds(F.col("id"))))
    fixity.write_warc(df.repartition(2), "record", str(tmp_path / "warc"), 2)
    got = {r["record_id"]: r for r in fixity.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert {k: (r["url"], bytes(r["body"]).decode()) for k, r in got.items()} == {f"<urn:id:{i}>": (u or "", b or "") for i, u, b in rows}
    assert got["<urn:id:3>"]["date"] == "1970-01-01T00:00:03Z" and got["<urn:id:3>"]["type"] == "response"
    assert {bytes(r["record"]).decode() for r in got.values()} == {r["record"] for r in df.collect()}
    for r in got.values():
        whole = open(r["file"].removeprefix("file:"), "rb").read()
        assert whole[r["offset"] : r["offset"] + r["n_bytes"]] == bytes(r["record"])
    name = str(tmp_path / "cut.warc")
    with open(name, "wb") as f:
        f.write(whole[:-7])
    with pytest.raises(Exception, match="does not end at its length|no record"):
        fixity.read_warc(spark, name).collect()
    empty = spark.createDataFrame([], "record string")
    fixity.write_warc(empty, "record", str(tmp_path / "none"))
    assert fixity.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_mixing(spark):
    rows = mixing.mix(docs(spark)).collect()
    assert len(rows) == docs(spark).count()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-6 for t, s in targets.values()) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    taken = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 for r in taken)
    whole = mixing.mixed(many)
    assert whole.columns == many.columns and 3 * whole.count() == sum(r["taken"] for r in taken)
    assert mixing.mix(none(spark)).count() == 0
