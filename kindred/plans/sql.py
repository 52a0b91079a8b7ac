"""The same plans in DuckDB's SQL, built from shared common table expressions."""

from __future__ import annotations

from kindred.functions.text import LEGAL_PATTERN
from kindred.operators.scoring import BIAS, LOGIT
from kindred.operators.training import SIDES
from kindred.sources.fixture import TRUE_PERCENT

FOUR = "('exact', 'prefix6', 'first_token', 'postal')"


def _n(x):
    return f"lower(trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[^a-zA-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')))"


def clean(x):
    return f"trim(regexp_replace(regexp_replace({x}, '{LEGAL_PATTERN}', ' ', 'gi'), '\\s+', ' ', 'g'))"


def _tokens(x):
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


_ENT = f"""ent AS (
  SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, CAST(1 + doc_id % 3 AS INT) AS source,
         array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS business_name,
         array_to_string(list_slice(string_split(text, ' '), 5, 12), ' ') || ' ' || (10000 + n_chars) AS business_address,
         upper(lang) AS country FROM documents),
norm0 AS (SELECT *, {_n('business_name')} AS name_norm, {_n('business_address')} AS addr_norm, lower(trim(coalesce(country, ''))) AS country_norm FROM ent),
norm AS (SELECT *, left(replace(name_norm, ' ', ''), 6) AS prefix6, split_part(name_norm, ' ', 1) AS first_token FROM norm0)"""

_WORDS = f"list_filter({_tokens('addr_norm')}, lambda t: NOT regexp_full_match(t, '[0-9]+') AND length(t) >= 3)"
_KEYS = f"""keys AS (SELECT DISTINCT * FROM (
  SELECT entity_id, source, 'exact' AS pass, country_norm AS country, name_norm AS key FROM norm WHERE name_norm <> ''
  UNION ALL SELECT entity_id, source, 'prefix6', country_norm, prefix6 FROM norm WHERE length(prefix6) = 6
  UNION ALL SELECT entity_id, source, 'first_token', country_norm, first_token FROM norm WHERE length(first_token) >= 5
  UNION ALL SELECT entity_id, source, 'postal', country_norm, unnest(list_filter(string_split(addr_norm, ' '), lambda t: regexp_full_match(t, '[0-9]{{5,6}}'))) FROM norm
  UNION ALL SELECT entity_id, source, 'exact_any_country', '', name_norm FROM norm WHERE name_norm <> ''
  UNION ALL SELECT entity_id, source, 'rare_name_token', country_norm, unnest(list_filter({_tokens('name_norm')}, lambda t: length(t) >= 3)) FROM norm
  UNION ALL SELECT entity_id, source, 'rare_addr_token', country_norm, unnest(list_filter({_tokens('addr_norm')}, lambda t: length(t) >= 3)) FROM norm
  UNION ALL SELECT entity_id, source, 'addr_tail', country_norm, list_extract(string_split(regexp_replace(addr_norm, ' [0-9]+$', ''), ' '), -1) FROM norm WHERE addr_norm <> ''
  UNION ALL SELECT entity_id, source, 'house_addr_token', country_norm, a || '|' || b FROM (SELECT entity_id, source, country_norm, addr_norm, unnest(list_filter({_tokens('addr_norm')}, lambda t: regexp_full_match(t, '[0-9]+'))) AS a FROM norm), unnest({_WORDS}) u(b)
  UNION ALL SELECT entity_id, source, 'name_addr_token', country_norm, a || '|' || b FROM (SELECT entity_id, source, country_norm, addr_norm, unnest(list_filter({_tokens('name_norm')}, lambda t: length(t) >= 3)) AS a FROM norm), unnest({_WORDS}) u(b))),
tkeys AS (SELECT * FROM keys WHERE source <> 1),
allowed AS (SELECT pass, country, key, count(*) AS n FROM tkeys GROUP BY ALL HAVING count(*) <= 250),
by_pass AS (SELECT DISTINCT a.pass, a.entity_id AS s1_id, b.entity_id AS cand_id FROM keys a JOIN allowed k USING (pass, country, key) JOIN tkeys b USING (pass, country, key) WHERE a.source = 1),
cand AS (SELECT DISTINCT s1_id, cand_id FROM by_pass WHERE pass IN {FOUR})"""

_TRUTH = f"""whole AS MATERIALIZED (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS id, 1 + doc_id % 3 AS source, {_tokens(_n('text'))} AS tokens FROM documents),
words AS MATERIALIZED (SELECT id, source, len(tokens) AS n, unnest(tokens) AS token FROM whole),
firsts AS MATERIALIZED (SELECT id, source, n, token FROM (SELECT w.*, row_number() OVER (PARTITION BY id ORDER BY df, token) AS place FROM words w JOIN (SELECT token, count(*) AS df FROM words GROUP BY token) USING (token))
  WHERE place <= n - ceil(n * {TRUE_PERCENT} / 100.0) + 1),
nears AS MATERIALIZED (SELECT DISTINCT a.id AS s1_id, b.id AS cand_id, a.n AS an, b.n AS bn FROM firsts a JOIN firsts b USING (token) WHERE a.source = 1 AND b.source <> 1 AND 100 * least(a.n, b.n) >= {TRUE_PERCENT} * greatest(a.n, b.n)),
truth AS MATERIALIZED (SELECT s1_id, cand_id FROM nears JOIN whole a ON a.id = s1_id JOIN whole b ON b.id = cand_id
  WHERE 100 * len(list_intersect(a.tokens, b.tokens)) >= {TRUE_PERCENT} * (an + bn - len(list_intersect(a.tokens, b.tokens))))"""


def _lcs(a, b):
    """Length of the longest common subsequence: one 128-bit row of the table per character of ``a``."""
    full = f"((1::HUGEINT << length({b})) - 1)"
    masks = f"list_transform(list_filter(string_split({a}, ''), lambda x: x <> ''), lambda x: coalesce(CAST(list_sum(list_transform(range(length({b})), lambda i: CASE WHEN substr({b}, CAST(i AS INT) + 1, 1) = x THEN 1::HUGEINT << CAST(i AS INT) ELSE 0::HUGEINT END)) AS HUGEINT), 0::HUGEINT))"
    # list_reduce starts from the first element: the row of no characters
    return f"(length({b}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def _ratio(a, b):
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


def _sorted(x):
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def _token_set(p):
    best = f"(2.0::DOUBLE * ({p}_len + {p}_gap + CASE WHEN {p}_l = '' OR {p}_r = '' THEN 0 ELSE {_lcs(f'{p}_l', f'{p}_r')} END)) / (2 * ({p}_len + {p}_gap) + length({p}_l) + length({p}_r))"
    i = f"2.0::DOUBLE * {p}_len"
    return f"""CASE WHEN {p}_x = 0 OR {p}_y = 0 THEN 0.0::DOUBLE WHEN {p}_len > 0 AND ({p}_l = '' OR {p}_r = '') THEN 1.0::DOUBLE
      WHEN {p}_len = 0 THEN {best}
      ELSE greatest({best}, {i} / (2 * {p}_len + {p}_gap + length({p}_l)), {i} / (2 * {p}_len + {p}_gap + length({p}_r))) END"""


def _set_parts(p, a, b):
    x, y = _tokens(a), _tokens(b)
    return f"""array_to_string(list_sort(list_filter({x}, lambda t: NOT list_contains({y}, t))), ' ') AS {p}_l,
      array_to_string(list_sort(list_filter({y}, lambda t: NOT list_contains({x}, t))), ' ') AS {p}_r,
      length(array_to_string(list_filter({x}, lambda t: list_contains({y}, t)), ' ')) AS {p}_len,
      CASE WHEN length(array_to_string(list_filter({x}, lambda t: list_contains({y}, t)), ' ')) > 0 THEN 1 ELSE 0 END AS {p}_gap,
      len({x}) AS {p}_x, len({y}) AS {p}_y"""


def _nums(x):
    return f"regexp_extract_all({x}, '\\b(\\d+)\\b', 1)"


_Z = " + ".join(f"{w}::DOUBLE * {c}" for c, w in LOGIT.items())
_FEATS = f"""attrs AS (SELECT p.s1_id, p.cand_id, a.name_norm AS s1_name, a.addr_norm AS s1_addr, a.country_norm AS s1_country,
    c.name_norm AS c_name, c.addr_norm AS c_addr, c.country_norm AS c_country
  FROM cand p JOIN norm a ON p.s1_id = a.entity_id JOIN norm c ON p.cand_id = c.entity_id WHERE a.country_norm = c.country_norm AND c.name_norm <> ''),
pre AS MATERIALIZED (SELECT *, {clean('s1_name')} AS s1_clean, {clean('c_name')} AS c_clean, {_sorted('s1_name')} AS n1, {_sorted('c_name')} AS n2,
    {_sorted('s1_addr')} AS a1, {_sorted('c_addr')} AS a2, {_set_parts('ns', 's1_name', 'c_name')}, {_set_parts('as_', 's1_addr', 'c_addr')} FROM attrs),
feats AS MATERIALIZED (SELECT s1_id, cand_id, s1_name, c_name,
    {_ratio('s1_name', 'c_name')} AS name_ratio, {_ratio('n1', 'n2')} AS name_token_sort, {_token_set('ns')} AS name_token_set,
    {_ratio('s1_clean', 'c_clean')} AS clean_name_ratio, {_ratio('s1_addr', 'c_addr')} AS address_ratio, {_ratio('a1', 'a2')} AS address_token_sort,
    {_token_set('as_')} AS address_token_set,
    CASE WHEN len({_nums('s1_addr')}) = 0 OR len({_nums('c_addr')}) = 0 THEN 0.0::DOUBLE WHEN list_has_any({_nums('s1_addr')}, {_nums('c_addr')}) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS number_match_score,
    CAST(CASE WHEN s1_country = c_country AND s1_country <> '' THEN 1 ELSE 0 END AS INT) AS country_match,
    CAST(abs(length(s1_name) - length(c_name)) AS INT) AS name_length_diff, CAST(abs(length(s1_addr) - length(c_addr)) AS INT) AS address_length_diff FROM pre),
scored AS MATERIALIZED (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({BIAS}::DOUBLE + {_Z}))) AS prob FROM feats),
clear AS (SELECT * FROM scored WHERE number_match_score <> -1 AND (clean_name_ratio >= 0.45 OR name_token_set >= 0.45)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id, target ORDER BY p6 DESC, cand_id) AS rank FROM
  (SELECT *, round(prob, 6) AS p6, split_part(cand_id, '-', 1) AS target FROM clear) WHERE p6 >= 0.9)"""

_PAIR = "s.entity_id AS s1_id, c.entity_id AS cand_id, s.name_norm AS s1_name, s.addr_norm AS s1_addr, s.country_norm AS s1_country, c.name_norm AS c_name, c.addr_norm AS c_addr, c.country_norm AS c_country"


def hash48(x):
    return f"CAST(('0x' || substr(md5({x} || '42'), 1, 12)) AS BIGINT)"


def _drawn(side, n):
    return f"(SELECT * FROM norm WHERE {side} AND {hash48('entity_id')} < {1 << 48}::DOUBLE * {n} / (SELECT count(*) FROM norm WHERE {side}))"


def _negative(kind, condition, drawn):
    own, targets = (_drawn(side, n) if drawn else f"(SELECT * FROM norm WHERE {side})" for side, n in zip(("source = 1", "source <> 1"), SIDES[kind]))
    return f"SELECT {_PAIR}, 0 AS label, '{kind}' AS pair_type FROM {own} s JOIN {targets} c ON s.country_norm = c.country_norm AND {condition} WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = s.entity_id AND t.cand_id = c.entity_id)"


def _training(drawn):
    return f"""training AS (
  SELECT {_PAIR}, 1 AS label, 'true_positive' AS pair_type FROM truth t JOIN norm s ON t.s1_id = s.entity_id JOIN norm c ON t.cand_id = c.entity_id
  UNION ALL {_negative('name_confusion', 's.name_norm = c.name_norm AND length(s.name_norm) >= 5 AND s.addr_norm <> c.addr_norm', drawn)}
  UNION ALL {_negative('prefix_confusion', 's.prefix6 = c.prefix6 AND length(s.prefix6) = 6 AND s.name_norm <> c.name_norm', drawn)}
  UNION ALL {_negative('token_confusion', 's.first_token = c.first_token AND length(s.first_token) >= 5 AND s.name_norm <> c.name_norm', drawn)}
  UNION ALL {_negative('same_addr_confusion', "s.addr_norm = c.addr_norm AND length(s.addr_norm) >= 10 AND c.name_norm <> '' AND s.name_norm <> c.name_norm AND s.first_token <> c.first_token", drawn)})"""


#: Negatives mined from drawn sides, and from all entities.
_TRAINING, MINED = _training(True), _training(False)


def norm(select):
    return f"WITH {_ENT} {select}"


def keys(select):
    return f"WITH {_ENT}, {_KEYS}, {_TRUTH} {select}"


def feats(select):
    return f"WITH {_ENT}, {_KEYS}, {_TRUTH}, {_FEATS} {select}"


def train(select):
    return f"WITH {_ENT}, {_TRUTH}, {_TRAINING} {select}"


def mined(select):
    """``train`` with all negatives there are."""
    return f"WITH {_ENT}, {_TRUTH}, {MINED} {select}"


def tenants(select, training=_TRAINING):
    """Over the entities in shared buildings of a few countries."""
    moved = _ENT.replace("ent AS (", "ent0 AS (", 1).replace("norm0 AS (", "ent AS (SELECT * REPLACE ('Building ' || (CAST(split_part(entity_id, '-', 2) AS BIGINT) % 101) || ', North Wing' AS business_address, 'C' || (CAST(split_part(entity_id, '-', 2) AS BIGINT) % 5) AS country) FROM ent0),\nnorm0 AS (", 1)
    return f"WITH {moved}, {_TRUTH}, {training} {select}"


PASS_GAIN = f"""SELECT pass, pairs, true_pairs, new_pairs, CAST(sum(new_pairs) OVER (ORDER BY place) AS BIGINT) AS cumulative_pairs, CAST(sum(new_true) OVER (ORDER BY place) AS BIGINT) AS cumulative_true FROM (
  SELECT place, pass, count(*) AS pairs, CAST(sum(hit) AS BIGINT) AS true_pairs, count(*) FILTER (WHERE place = first) AS new_pairs, CAST(coalesce(sum(hit) FILTER (WHERE place = first), 0) AS BIGINT) AS new_true FROM (
    SELECT *, min(place) OVER (PARTITION BY s1_id, cand_id) AS first FROM (
      SELECT p.*, CASE p.pass WHEN 'exact' THEN 0 WHEN 'prefix6' THEN 1 WHEN 'first_token' THEN 2 ELSE 3 END AS place, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS hit
      FROM by_pass p LEFT JOIN truth t USING (s1_id, cand_id) WHERE p.pass IN {FOUR})) GROUP BY place, pass)"""

MISSED = f"""SELECT t.s1_id, t.cand_id, CASE WHEN EXISTS (SELECT 1 FROM keys a JOIN keys b USING (pass, country, key) WHERE a.entity_id = t.s1_id AND b.entity_id = t.cand_id AND a.pass IN {FOUR}) THEN 'cap_suppressed' ELSE 'no_shared_key' END AS reason
  FROM truth t ANTI JOIN cand USING (s1_id, cand_id)"""

IDF = """, tok AS (SELECT entity_id, source, unnest(list_distinct(string_split(name_norm, ' '))) AS token FROM norm), tk AS (SELECT * FROM tok WHERE length(token) >= 2),
  df AS (SELECT token, count(*) FILTER (WHERE source <> 1) AS df FROM tk GROUP BY token HAVING count(*) FILTER (WHERE source <> 1) BETWEEN 1 AND 5000 AND count(*) FILTER (WHERE source = 1) <= 5000),
  w AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, round(sum(1 / log2(df + 2)), 6) AS weight FROM tk a JOIN df USING (token) JOIN tk b USING (token) WHERE a.source = 1 AND b.source <> 1 GROUP BY ALL)
  SELECT s1_id, cand_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY weight DESC, cand_id) AS rn FROM w) WHERE rn <= 300"""

CONFUSION = """SELECT s1_id, cand_id, category FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, category ORDER BY round(prob, 9) DESC, cand_id) AS rn FROM (
  SELECT *, CASE WHEN name_ratio >= 0.8 AND address_ratio < 0.5 THEN 'name' WHEN address_ratio >= 0.8 AND name_ratio < 0.5 THEN 'address' WHEN name_ratio >= 0.6 AND address_ratio >= 0.6 THEN 'both' END AS category
  FROM scored ANTI JOIN truth USING (s1_id, cand_id)) WHERE category IS NOT NULL) WHERE rn = 1"""

_F = "CASE WHEN 0.25 * {p} + {r} > 0 THEN 1.25::DOUBLE * {p} * {r} / (0.25::DOUBLE * {p} + {r}) ELSE 0.0::DOUBLE END"


def sweep(thresholds):
    grid = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0::DOUBLE END"
    return f"""SELECT threshold, predictions, true_positives, predictions - true_positives AS false_positives, rec - true_positives AS false_negatives, n - predictions - rec + true_positives AS true_negatives,
      round(p, 9) AS "precision", round(r, 9) AS recall, round(e, 9) AS end_to_end_recall, round({_F.format(p='p', r='r')}, 9) AS f_half, round({_F.format(p='p', r='e')}, 9) AS end_to_end_f_half FROM (
      SELECT *, {rate('true_positives', 'predictions')} AS p, {rate('true_positives', 'rec')} AS r, {rate('true_positives', '(SELECT count(*) FROM truth)')} AS e FROM (
        SELECT g.threshold, count(*) FILTER (WHERE x.pr >= g.threshold) AS predictions, count(*) FILTER (WHERE x.pr >= g.threshold AND x.hit) AS true_positives, count(*) FILTER (WHERE x.hit) AS rec, count(*) AS n
        FROM (VALUES {grid}) g(threshold), (SELECT round(s.prob, 6) AS pr, t.s1_id IS NOT NULL AS hit FROM scored s LEFT JOIN truth t USING (s1_id, cand_id)) x GROUP BY g.threshold))"""


MACRO = f"""SELECT count(*) AS entities, count(*) FILTER (WHERE p = 0) AS no_match_count, round(avg(CASE WHEN t = 0 AND p = 0 THEN 1.0::DOUBLE WHEN t = 0 OR tp = 0 THEN 0.0::DOUBLE
  ELSE {_F.format(p='(CAST(tp AS DOUBLE) / p)', r='(CAST(tp AS DOUBLE) / t)')} END), 9) AS macro_f_half FROM (
  SELECT e.entity_id, (SELECT count(*) FROM truth t WHERE t.s1_id = e.entity_id) AS t, count(m.cand_id) AS p, count(h.cand_id) AS tp
  FROM ent e LEFT JOIN (SELECT * FROM clear WHERE prob >= 0.9) m ON m.s1_id = e.entity_id LEFT JOIN truth h ON h.s1_id = m.s1_id AND h.cand_id = m.cand_id WHERE e.source = 1 GROUP BY e.entity_id)"""


RATIO_SWEEP = """, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(s1_id || cand_id || pair_type || '42'), s1_id, cand_id, pair_type) AS rn FROM training)
  SELECT CAST(k AS INT) AS ratio, label, pair_type, count(*) AS n FROM r, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE label = 1 OR rn <= k * (SELECT count(*) FROM training WHERE label = 1) GROUP BY ALL"""

RANDOM_NEGATIVES = f""", n AS (SELECT greatest(1, count(*) // 32) AS n FROM ent WHERE source <> 1),
  a AS (SELECT entity_id AS s1_id, {hash48('entity_id')} % n.n AS b FROM ent, n WHERE source = 1), c AS (SELECT entity_id AS cand_id, {hash48('entity_id')} % n.n AS b FROM ent, n WHERE source <> 1),
  p AS (SELECT s1_id, cand_id FROM a JOIN c USING (b) ANTI JOIN truth USING (s1_id, cand_id))
  SELECT s1_id, cand_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY md5(s1_id || cand_id), cand_id) AS rn FROM p) WHERE rn <= 2"""

COUNTRY = """, few AS (SELECT name_norm FROM norm WHERE source <> 1 GROUP BY 1 HAVING count(*) <= 250)
  SELECT s.entity_id AS s1_id, c.entity_id AS cand_id FROM norm s JOIN norm c ON s.source = 1 AND c.source <> 1 AND s.name_norm = c.name_norm AND s.country_norm <> c.country_norm
  WHERE length(s.name_norm) >= 5 AND c.name_norm IN (SELECT name_norm FROM few) AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1_id = s.entity_id AND t.cand_id = c.entity_id)"""

PER_SOURCE_CAPS = f""", tk AS (SELECT *, 'S' || source AS target FROM tkeys WHERE pass IN {FOUR}),
  fit AS (SELECT pass, target, country, key FROM tk GROUP BY ALL HAVING count(*) <= 250)
  SELECT DISTINCT t.pass, t.target, k.entity_id AS s1_id, t.entity_id AS cand_id FROM keys k JOIN tk t USING (pass, country, key) JOIN fit USING (pass, target, country, key) WHERE k.source = 1"""

MISSED_OVERLAPS = f"""SELECT t.s1_id, t.cand_id, CAST(len(list_intersect({_tokens('a.name_norm')}, {_tokens('b.name_norm')})) AS BIGINT) AS shared_name_tokens, CAST(len(list_intersect({_tokens('a.addr_norm')}, {_tokens('b.addr_norm')})) AS BIGINT) AS shared_addr_tokens
  FROM truth t ANTI JOIN cand USING (s1_id, cand_id) JOIN norm a ON a.entity_id = t.s1_id JOIN norm b ON b.entity_id = t.cand_id"""

LEAKAGE = """, split AS (SELECT entity_id AS s1_id, row_number() OVER (ORDER BY md5(entity_id || '42'), entity_id) <= 100 AS held FROM ent WHERE source = 1),
  per AS (SELECT cand_id, bool_or(held) AND bool_or(NOT held) AS mixed FROM truth JOIN split USING (s1_id) GROUP BY cand_id)
  SELECT count(*) AS targets, count(*) FILTER (WHERE mixed) AS "both", round(CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE mixed) AS DOUBLE) / count(*) ELSE 0.0 END, 9) AS share FROM per"""


def selective(select, most, per_entity):
    """Keys without generic tokens, capped blocks, and a cap of candidates from each token pass."""
    six, four = "('exact', 'prefix6', 'first_token', 'postal', 'house_addr_token', 'name_addr_token', 'rare_name_token', 'rare_addr_token')", "('house_addr_token', 'name_addr_token', 'rare_name_token', 'rare_addr_token')"
    return keys(f""", generic AS (SELECT country, key AS token FROM (SELECT DISTINCT entity_id, country, key FROM tkeys WHERE pass IN ('rare_name_token', 'rare_addr_token')) GROUP BY ALL HAVING count(*) > {most}),
  bad AS (SELECT DISTINCT pass, country, key FROM (SELECT pass, country, key, unnest(CASE WHEN pass = 'house_addr_token' THEN [split_part(key, '|', 2)] ELSE string_split(key, '|') END) AS token FROM keys WHERE pass IN {four}) SEMI JOIN generic USING (country, token)),
  good AS (SELECT * FROM keys WHERE pass IN {six} AND (pass, country, key) NOT IN (SELECT (pass, country, key) FROM bad)),
  fit AS (SELECT pass, country, key, count(*) AS n FROM good WHERE source <> 1 GROUP BY ALL HAVING count(*) <= 250),
  met AS (SELECT a.pass, a.entity_id AS s1_id, b.entity_id AS cand_id, min(n) AS n FROM good a JOIN fit USING (pass, country, key) JOIN good b USING (pass, country, key) WHERE a.source = 1 AND b.source <> 1 GROUP BY ALL),
  chosen AS (SELECT pass, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY pass, s1_id ORDER BY n, cand_id) AS rn FROM met) WHERE pass NOT IN {four} OR rn <= {per_entity})
  {select}""")


def macro_sweep(thresholds):
    grid = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    each = f"CASE WHEN t = 0 AND p = 0 THEN 1.0::DOUBLE WHEN t = 0 OR tp = 0 THEN 0.0::DOUBLE ELSE {_F.format(p='(CAST(tp AS DOUBLE) / p)', r='(CAST(tp AS DOUBLE) / t)')} END"
    return f""", best AS (SELECT * FROM (SELECT s1_id, cand_id, p6, row_number() OVER (PARTITION BY s1_id, split_part(cand_id, '-', 1) ORDER BY p6 DESC, cand_id) AS rn FROM (SELECT *, round(prob, 6) AS p6 FROM clear)) WHERE rn <= 3),
  tr AS (SELECT s1_id, count(*) AS t FROM truth GROUP BY s1_id),
  cells AS (SELECT g.threshold, e.entity_id, coalesce(any_value(tr.t), 0) AS t, count(b.cand_id) AS p, count(h.cand_id) AS tp
    FROM (SELECT entity_id FROM ent WHERE source = 1) e CROSS JOIN (VALUES {grid}) g(threshold) LEFT JOIN tr ON tr.s1_id = e.entity_id
    LEFT JOIN best b ON b.s1_id = e.entity_id AND b.p6 >= g.threshold LEFT JOIN truth h ON h.s1_id = b.s1_id AND h.cand_id = b.cand_id GROUP BY g.threshold, e.entity_id),
  per AS (SELECT threshold, CAST(sum(p) AS BIGINT) AS predictions, CAST(sum(tp) AS BIGINT) AS true_positives, count(*) FILTER (WHERE p = 0) AS no_match_count, avg({each}) AS macro, CAST(sum(t) AS BIGINT) AS t FROM cells GROUP BY threshold),
  rates AS (SELECT *, CASE WHEN predictions > 0 THEN CAST(true_positives AS DOUBLE) / predictions ELSE 0.0::DOUBLE END AS p, CASE WHEN t > 0 THEN CAST(true_positives AS DOUBLE) / t ELSE 0.0::DOUBLE END AS r FROM per),
  swept AS (SELECT threshold, predictions, true_positives, no_match_count, predictions - true_positives AS false_positives, round(p, 9) AS "precision", round(r, 9) AS recall, round(macro, 9) AS macro_f_half, round({_F.format(p='p', r='r')}, 9) AS micro_f_half FROM rates)"""
