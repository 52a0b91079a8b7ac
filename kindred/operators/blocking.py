"""Candidate generation: one long key table serves every pass, capped before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.text import first_token, last_token, normalize, normalize_country, prefix6, tokens

CAP = 250
#: Passes in the order in which gains are reported.
PASSES = ("exact", "prefix6", "first_token", "postal")
#: Passes over single tokens or pairs of them, and the selective union: the four passes and two of these.
TOKEN_PASSES = ("house_addr_token", "name_addr_token", "rare_name_token", "rare_addr_token")
SELECTIVE_PASSES = (*PASSES, "house_addr_token", "name_addr_token")
#: Targets of a country beyond which a token counts as generic, and candidates of an entity from one token pass.
GENERIC, PER_ENTITY = 100, 200
EXTRA_PASSES = ("house_addr_token", "name_addr_token", "exact_any_country", "rare_name_token", "rare_addr_token", "addr_tail")


def normalized(entities: DataFrame) -> DataFrame:
    """Adds name_norm, addr_norm, country_norm, prefix6 and first_token, computed once per entity."""
    out = entities.withColumns({"name_norm": normalize(F.col("business_name")), "addr_norm": normalize(F.col("business_address")), "country_norm": normalize_country(F.col("country"))})
    return out.withColumns({"prefix6": prefix6(F.col("name_norm")), "first_token": first_token(F.col("name_norm"))})


def dedupe(entities: DataFrame) -> DataFrame:
    """One row per entity_id: the first by name, address and country."""
    order = W.partitionBy("entity_id").orderBy("business_name", "business_address", "country")
    return entities.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def _long(array):
    return F.filter(array, lambda t: F.length(t) >= 3)


def _arrays(passes) -> list:
    """For each pass the array of an entity's (pass, country, key)."""
    one = lambda ok, key: F.when(ok, F.array(key)).otherwise(F.array().cast("array<string>"))
    name, addr = F.col("name_norm"), F.col("addr_norm")
    numbers = F.filter(tokens(addr), lambda t: t.rlike("^[0-9]+$"))
    words = _long(F.filter(tokens(addr), lambda t: ~t.rlike("^[0-9]+$")))
    cross = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y))))
    made = {
        "exact": one(name != "", name),
        "prefix6": one(F.length("prefix6") == 6, F.col("prefix6")),
        "first_token": one(F.length("first_token") >= 5, F.col("first_token")),
        "postal": F.filter(tokens(addr), lambda t: t.rlike("^[0-9]{5,6}$")),
        "house_addr_token": cross(numbers, words),
        "name_addr_token": cross(_long(tokens(name)), words),
        "exact_any_country": one(name != "", name),
        "rare_name_token": _long(tokens(name)),
        "rare_addr_token": _long(tokens(addr)),
        "addr_tail": one(addr != "", last_token(F.regexp_replace(addr, " [0-9]+$", ""))),
    }

    def tagged(p):
        country = F.lit("") if p == "exact_any_country" else F.col("country_norm")
        return F.transform(made[p], lambda k: F.struct(F.lit(p).alias("pass"), country.alias("country"), k.alias("key")))

    return [tagged(p) for p in passes]


def keys(norm: DataFrame, passes=PASSES) -> DataFrame:
    """(entity_id, pass, country, key), distinct; an explode of one small array per entity, no rescan per pass."""
    return norm.select("entity_id", F.explode(F.concat(*_arrays(passes))).alias("k")).select("entity_id", "k.*").distinct()


#: Bits of a key's hash below the place of its pass (16 passes at most).
KEY_BITS = 59


def hashed_keys(passes=PASSES):
    """An entity's keys as an array of (key, more), 91 bits of hash: ``key`` has the place of the pass on top, so that keys sort by it."""
    of = lambda i: lambda k: F.struct(F.shiftrightunsigned(F.xxhash64(k["country"], k["key"]), 64 - KEY_BITS).bitwiseOR(F.lit(i << KEY_BITS)).alias("key"), F.hash(k["country"], k["key"]).alias("more"))
    return F.concat(*(F.transform(parts, of(i)) for i, parts in enumerate(_arrays(passes))))


def fitting(norm: DataFrame, passes=PASSES, cap: int = CAP) -> DataFrame:
    """(cand_id, theirs): each target's hashed keys of allowed blocks, in order."""
    rows = norm.filter("source <> 1").select(F.col("entity_id").alias("cand_id"), F.explode(hashed_keys(passes)).alias("k")).select("cand_id", "k.*")
    fits = rows.groupBy("key", "more").agg(F.count("*").alias("n")).filter(F.col("n") <= cap)
    return rows.join(fits, ["key", "more"], "left_semi").groupBy("cand_id").agg(F.array_sort(F.collect_list(F.struct("key", "more"))).alias("theirs"))


def true_lists(truth: DataFrame) -> DataFrame:
    """(s1_id, true): the true candidates of each entity that has any."""
    return truth.groupBy("s1_id").agg(F.collect_list("cand_id").alias("true"))


def is_true():
    """Whether a row's ``cand_id`` is in its list ``true`` (see ``true_lists``)."""
    return F.coalesce(F.array_contains("true", F.col("cand_id")), F.lit(False)).cast("int")


def met(norm: DataFrame, truth: DataFrame | None = None, columns: dict[str, str] | None = None, passes=PASSES, cap: int = CAP) -> DataFrame:
    """The pairs of ``candidates`` where they meet, each once a pass: (s1_id, cand_id, place of the pass, new) and, with ``truth``, is_true.

    ``new`` marks the row of a pair in its first pass, so ``new`` rows are the
    candidates.  Entities bring their keys, true candidates and ``columns``
    (column of ``norm``: name, given as s1_name and c_name) to each block, and
    a pair is left out but at its first common key of a pass: pairs are never
    moved, and what is moved grows with the entities.  Ids are unique.
    """
    take = lambda p: [F.col(c).alias(f"{p}_{n}") for c, n in (columns or {}).items()]
    own = norm.filter("source = 1").select(F.col("entity_id").alias("s1_id"), *take("s1"), hashed_keys(passes).alias("mine"))
    if truth is not None:
        own = own.join(true_lists(truth), "s1_id", "left")
    target = fitting(norm, passes, cap)
    if columns:
        target = target.join(norm.filter("source <> 1").select(F.col("entity_id").alias("cand_id"), *take("c")), "cand_id")
    a = own.withColumn("k", F.explode("mine")).select("*", "k.*").withColumn("mine", F.col("mine.key")).drop("k")
    b = target.withColumn("k", F.explode("theirs")).select("*", "k.*").withColumn("theirs", F.col("theirs.key")).drop("k")
    place = lambda k: F.shiftrightunsigned(k, KEY_BITS)
    pairs = a.join(b, ["key", "more"]).withColumn("common", F.array_intersect("theirs", "mine"))
    pairs = pairs.filter(F.filter("common", lambda k: place(k) == place(F.col("key")))[0] == F.col("key"))
    truths = [is_true().alias("is_true")] if truth is not None else []
    return pairs.select("s1_id", "cand_id", place(F.col("key")).cast("int").alias("place"), (F.col("common")[0] == F.col("key")).alias("new"), *truths, *(f"{p}_{n}" for p in ("s1", "c") for n in (columns or {}).values()))


def among(pairs: DataFrame, norm: DataFrame, passes=PASSES, cap: int = CAP) -> DataFrame:
    """Those of some pairs (s1_id, cand_id) that are candidates; no others are made."""
    own = norm.filter("source = 1").select(F.col("entity_id").alias("s1_id"), hashed_keys(passes).alias("mine"))
    return pairs.join(own, "s1_id").join(fitting(norm, passes, cap), "cand_id").filter(F.arrays_overlap("mine", "theirs")).select("s1_id", "cand_id")


def allowed(target_keys: DataFrame, cap: int = CAP) -> DataFrame:
    """Blocks of at most ``cap`` targets; larger ones are suppressed whole, as the matcher defines it."""
    return target_keys.groupBy("pass", "country", "key").agg(F.count("*").alias("n")).filter(F.col("n") <= cap)


def pairs_by_pass(s1_keys: DataFrame, target_keys: DataFrame, cap: int = CAP) -> DataFrame:
    """(pass, s1_id, cand_id) through capped blocks, semi-joined before the pair join; ids only."""
    on = ["pass", "country", "key"]
    kept = target_keys.join(allowed(target_keys, cap), on, "left_semi")
    return s1_keys.withColumnRenamed("entity_id", "s1_id").join(kept.withColumnRenamed("entity_id", "cand_id"), on).select("pass", "s1_id", "cand_id").distinct()


def candidates(norm: DataFrame, passes=PASSES, cap: int = CAP) -> DataFrame:
    """(s1_id, cand_id) of all passes, each pair once.  ``norm`` has a ``source`` column (1, 2, 3)."""
    own, target = norm.filter("source = 1"), norm.filter("source <> 1")
    return pairs_by_pass(keys(own, passes), keys(target, passes), cap).select("s1_id", "cand_id").distinct()


def generic_tokens(target_keys: DataFrame, most: int = GENERIC) -> DataFrame:
    """(country, token) of tokens in more than ``most`` targets; ``target_keys`` has the passes on single tokens."""
    single = target_keys.filter(F.col("pass").isin("rare_name_token", "rare_addr_token")).select("entity_id", "country", F.col("key").alias("token")).distinct()
    return single.groupBy("country", "token").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("country", "token")


def specific(some_keys: DataFrame, generic: DataFrame) -> DataFrame:
    """Keys without those of token passes that hold a generic token."""
    tokens = F.when(F.col("pass") == "house_addr_token", F.array(F.split_part("key", F.lit("|"), F.lit(2)))).otherwise(F.split("key", r"\|"))
    plain, composite = some_keys.filter(~F.col("pass").isin(*TOKEN_PASSES)), some_keys.filter(F.col("pass").isin(*TOKEN_PASSES))
    parts = composite.select("*", F.explode(tokens).alias("token"))
    bad = parts.join(generic, ["country", "token"], "left_semi").select("pass", "country", "key").distinct()
    return plain.unionByName(composite.join(bad, ["pass", "country", "key"], "left_anti"))


def selective_pairs(norm: DataFrame, passes=SELECTIVE_PASSES, cap: int = CAP, most: int = GENERIC, per_entity: int = PER_ENTITY) -> DataFrame:
    """(pass, s1_id, cand_id) through capped blocks, generic tokens left out, and from each token pass
    at most ``per_entity`` candidates of an entity: those of its least blocks, ties by id."""
    on = ["pass", "country", "key"]
    own, target = norm.filter("source = 1"), norm.filter("source <> 1")
    generic = generic_tokens(keys(target, ("rare_name_token", "rare_addr_token")), most)
    own_keys, target_keys = specific(keys(own, passes), generic), specific(keys(target, passes), generic)
    kept = target_keys.join(allowed(target_keys, cap), on)
    met = own_keys.withColumnRenamed("entity_id", "s1_id").join(kept.withColumnRenamed("entity_id", "cand_id"), on)
    best = met.groupBy("pass", "s1_id", "cand_id").agg(F.min("n").alias("n"))
    place = F.row_number().over(W.partitionBy("pass", "s1_id").orderBy("n", "cand_id"))
    return best.withColumn("place", place).filter(~F.col("pass").isin(*TOKEN_PASSES) | (F.col("place") <= per_entity)).select("pass", "s1_id", "cand_id")


def pairs_by_source(norm: DataFrame, passes=PASSES, cap: int = CAP) -> DataFrame:
    """(pass, target, s1_id, cand_id): each target source has blocks and caps of its own."""
    on = ["pass", "target", "country", "key"]
    of = norm.select("entity_id", F.concat(F.lit("S"), F.col("source").cast("string")).alias("target"))
    target_keys = keys(norm.filter("source <> 1"), passes).join(of, "entity_id")
    fits = target_keys.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") <= cap)
    kept = target_keys.join(fits, on, "left_semi").withColumnRenamed("entity_id", "cand_id")
    return keys(norm.filter("source = 1"), passes).withColumnRenamed("entity_id", "s1_id").join(kept, ["pass", "country", "key"]).select("pass", "target", "s1_id", "cand_id").distinct()


def widen(norm: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per source-1 entity with its candidates as a comma list in order, '' when none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("candidate_entity_ids"))
    own = norm.filter("source = 1").select(F.col("entity_id").alias("source1_entity_id"))
    return own.join(lists, own["source1_entity_id"] == lists["s1_id"], "left").select("source1_entity_id", F.coalesce("candidate_entity_ids", F.lit("")).alias("candidate_entity_ids"))


def pass_gain(pairs: DataFrame, passes=PASSES) -> DataFrame:
    """Per pass: pairs, pairs new to the union so far, true pairs in it, and cumulative counts; ``pairs`` are those of ``met``."""
    count = lambda c: F.sum(c.cast("long"))
    new, true = F.col("new").cast("int"), F.col("is_true")
    per = pairs.groupBy("place").agg(F.count("*").alias("pairs"), count(true).alias("true_pairs"), count(new).alias("new_pairs"), count(new * true).alias("new_true"))
    order = W.orderBy("place")
    name = F.element_at(F.array(*map(F.lit, passes)), F.col("place") + 1)
    return per.select(name.alias("pass"), "pairs", "true_pairs", "new_pairs", F.sum("new_pairs").over(order).alias("cumulative_pairs"), F.sum("new_true").over(order).alias("cumulative_true"))


def missed(truth: DataFrame, pairs: DataFrame, s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(s1_id, cand_id, reason): true pairs without a candidate, by no_shared_key or cap_suppressed."""
    lost = truth.join(pairs, ["s1_id", "cand_id"], "left_anti")
    a = lost.join(s1_keys.withColumnRenamed("entity_id", "s1_id"), "s1_id")
    shared = a.join(target_keys.withColumnRenamed("entity_id", "cand_id"), ["cand_id", "pass", "country", "key"]).select("s1_id", "cand_id").distinct().withColumn("reason", F.lit("cap_suppressed"))
    return lost.join(shared, ["s1_id", "cand_id"], "left").na.fill("no_shared_key", ["reason"])


def missed_overlaps(truth: DataFrame, pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """(s1_id, cand_id, shared_name_tokens, shared_addr_tokens) of true pairs without a candidate."""
    side = lambda p, key: norm.select(F.col("entity_id").alias(key), tokens(F.col("name_norm")).alias(f"{p}_name"), tokens(F.col("addr_norm")).alias(f"{p}_addr"))
    lost = truth.join(pairs, ["s1_id", "cand_id"], "left_anti").join(side("a", "s1_id"), "s1_id").join(side("b", "cand_id"), "cand_id")
    return lost.select("s1_id", "cand_id", *(F.size(F.array_intersect(f"a_{c}", f"b_{c}")).cast("long").alias(f"shared_{c}_tokens") for c in ("name", "addr")))


def stats(norm: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs in all, and their mean and greatest number per source-1 entity (none counts as 0)."""
    per = norm.filter("source = 1").select(F.col("entity_id").alias("s1_id")).join(pairs.groupBy("s1_id").count(), "s1_id", "left").na.fill(0)
    return per.agg(F.sum("count").alias("candidate_pairs"), F.avg("count").alias("mean_candidates"), F.max("count").alias("max_candidates"))
