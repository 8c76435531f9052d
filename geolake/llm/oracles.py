"""SQL that must give the same rows as queries of this subpackage."""

from __future__ import annotations

from . import licenses, quality, sharding

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 80 * (na.n + nb.n - same)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _licenses() -> str:
    """By the definition: places of all key phrases' words, enough of the template's rarest words in place, the matching share."""
    q, rows = licenses, []
    for k, p in enumerate(licenses.patterns()):
        rows.append(f"({k}, '{p.label}', {str(p.base).lower()}, {_list(p.words)}, {list(p.must)}, {_list(p.must.values())})")
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{q.GAP}'), lambda x: x <> '') AS ws FROM documents),
p(k, label, base, pw, off, mw) AS (VALUES {", ".join(rows)}),
pos AS MATERIALIZED (SELECT k, unnest(pw) AS w, unnest(range(0, len(pw))) AS i FROM p),
df AS MATERIALIZED (SELECT w, count(doc_id) AS df, 1 + ln((1 + (SELECT count(*) FROM d)) / CAST(1 + count(doc_id) AS DOUBLE)) AS x
  FROM (SELECT DISTINCT w FROM pos) v LEFT JOIN (SELECT doc_id, unnest(list_distinct(ws)) AS w FROM d) e USING (w) GROUP BY w),
ranked AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY df, w) AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT DISTINCT k, w FROM pos) JOIN df USING (w)),
rare AS (SELECT k, w, least({q.INDEXED}, (n + 2) // 3) AS most FROM ranked WHERE r <= least({q.INDEXED}, (n + 2) // 3)),
q AS MATERIALIZED (SELECT p.*, px, roff, (SELECT (max(most) + 1) // 2 FROM rare WHERE rare.k = p.k) AS need FROM p
  JOIN (SELECT k, list(x ORDER BY i) AS px FROM pos JOIN df USING (w) GROUP BY k) USING (k) JOIN (SELECT k, list(i) AS roff FROM pos JOIN rare USING (k, w) GROUP BY k) USING (k)),
s AS (SELECT d.doc_id, d.ws, q.*, unnest(list_transform(list_filter(range(0, len(ws)), lambda j: ws[j + 1] = mw[1]), lambda j: j - off[1])) AS start FROM d, q WHERE list_has_all(ws, mw)),
t AS (SELECT * FROM s WHERE len(list_filter(range(1, len(off) + 1), lambda j: start + off[j] >= 0 AND ws[start + off[j] + 1] = mw[j])) = len(off)
  AND len(list_filter(roff, lambda o: start + o >= 0 AND ws[start + o + 1] = pw[o + 1])) >= need),
m AS (SELECT doc_id, start, label, base, CASE WHEN base THEN 1.0 ELSE round(least(list_sum(list_transform(range(1, len(pw) + 1), lambda i: CASE WHEN start + i - 1 >= 0 AND ws[start + i] = pw[i] THEN px[i] ELSE 0 END)) / list_sum(px), 1.0), 6) END AS score FROM t),
g AS (SELECT * FROM m WHERE base OR score >= {licenses.LEAST_SCORE})
SELECT d.doc_id, len(d.ws) AS n_words, count(g.start) FILTER (g.base) AS n_base, min(g.start) FILTER (g.base) AS first_word, max(g.start) FILTER (g.base) AS last_word,
  coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label) FILTER (g.base), '') AS base_labels, coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label), '') AS labels, CAST(coalesce(max(g.score), 0) AS DOUBLE) AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id, d.ws
"""


def _sharding(shards: int = 16) -> str:
    """The slot maps are lists built from their rule; the checksum is taken bit by bit."""
    bits = r"flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: list_transform(range(0, 8), lambda k: (CAST('0x' || h AS BIGINT) >> k) & 1)))"
    crc = f"xor(list_reduce({bits}, lambda acc, b: xor(acc >> 1, 3988292384 * (xor(acc, b) & 1)), 4294967295::BIGINT), 4294967295)"
    return rf"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc} END AS text_crc32, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.SLOTS} AS vslot FROM documents),
m AS (SELECT *, {sharding.slot_owners(shards)}[vslot + 1] AS shard, {sharding.slot_owners(shards + 1)}[vslot + 1] AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, text_crc32, size) - 1 AS slot, grown_shard, vslot, {shards} AS map_version, CAST(sum(size) OVER (PARTITION BY vslot) AS BIGINT) AS slot_bytes FROM m
"""


def _quality() -> str:
    """Signals, rules, the choice of rules, exact binomial tails and cutoffs, step by step as in quality.py."""
    q = quality
    mean = "coalesce(CAST(word_chars AS DOUBLE) / nullif(n_words, 0), 0)"
    share = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
    rules = {
        "symbols": f"least({share('n_symbols', 'word_chars')}, 1)", "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "n_letters"),
        "long_words": f"least({mean} / 40, 1)", "short_words": f"CASE WHEN n_words > 0 THEN 1 - least({mean} / 10, 1) ELSE 1 END", "few_words": "1 / (1 + CAST(n_words AS DOUBLE) / 10)",
        "same_words": f"1 - CASE WHEN n_words > 0 THEN {share('n_distinct', 'n_words')} ELSE 1 END",
    }
    scored = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, CAST(least(floor(({e}) * {q.BINS}), {q.BINS - 1}) AS INT) AS bin FROM m" for r, e in rules.items())
    # greedy choice: a round for each rule at most; a round that gains nothing leaves no documents to the next ones
    rounds, before = "", "SELECT ''"
    for i in range(len(rules)):
        rounds += f"""g{i} AS MATERIALIZED (SELECT rule, cut, CAST(count(*) FILTER (NOT good AND bin >= cut) AS DOUBLE) / any_value(n_bad) - {q.LOSS} * (CAST(count(*) FILTER (good AND bin >= cut) AS DOUBLE) / any_value(n_good)) AS gain
  FROM c{i}, cuts, whole WHERE cut > 0 AND rule NOT IN ({before}) GROUP BY 1, 2),
p{i} AS MATERIALIZED (SELECT rule, cut FROM g{i} WHERE gain > 1e-12 ORDER BY round(gain, 12) DESC, rule, cut DESC LIMIT 1),
c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE EXISTS (SELECT 1 FROM p{i}) AND doc_id NOT IN (SELECT c.doc_id FROM c{i} c JOIN p{i} p ON p.rule = c.rule AND c.bin >= p.cut)),
"""
        before += f" UNION ALL SELECT rule FROM p{i}"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + {q.WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {q.WINDOW - 2})) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, {q.WINDOW}) z(k) GROUP BY 1),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
s AS (SELECT l.doc_id, stratum, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters, len(list_distinct(ws)) AS n_distinct
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id),
m AS (SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEAT_PERCENT} AS base_failed FROM s),
b AS ({scored}),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
x AS (SELECT b.*, good, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 = 0 AS choosing FROM b JOIN lab USING (doc_id) WHERE NOT base_failed),
y AS (SELECT stratum, rule, bin, good, choosing FROM x UNION ALL SELECT '', rule, bin, good, choosing FROM x WHERE stratum <> ''),
cuts AS (SELECT cut FROM range(0, {q.BINS}) z(cut)),
c0 AS MATERIALIZED (SELECT doc_id, rule, bin, good FROM x WHERE choosing),
whole AS (SELECT greatest(count(*) FILTER (good), 1) AS n_good, greatest(count(*) FILTER (NOT good), 1) AS n_bad FROM c0 WHERE rule = 'symbols'),
{rounds}chosen AS (SELECT rule FROM ({before}) z(rule) WHERE rule <> ''),
above AS (SELECT stratum, rule, cut, count(*) FILTER (good AND bin >= cut) AS k, count(*) FILTER (good) AS n, count(*) FILTER (NOT good AND bin >= cut) AS hit, count(*) FILTER (NOT good) AS bad FROM y, cuts WHERE NOT choosing GROUP BY ALL),
gain AS (SELECT *, CAST(hit AS DOUBLE) / greatest(bad, 1) - {q.LOSS} * k / greatest(n, 1) AS gain FROM above),
strata AS (SELECT DISTINCT stratum FROM y WHERE NOT choosing),
tests AS (SELECT (SELECT count(*) FROM chosen) AS rules, (SELECT count(*) FROM strata) AS strata),
tail AS (SELECT stratum, rule, cut, gain, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.ALPHA} / rules) + (n - i) * ln(1 - {q.ALPHA} / rules)))) END AS p, {q.DELTA} / (strata * rules) AS level
  FROM gain, tests WHERE n > 0 AND cut > 0 AND k < n AND gain > 0 AND rule IN (SELECT rule FROM chosen)),
final AS (SELECT stratum, rule, cut FROM tail WHERE p <= level QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY round(gain, 12) DESC, cut DESC) = 1),
j AS (SELECT b.doc_id, b.rule FROM b JOIN final f ON f.rule = b.rule AND f.stratum = CASE WHEN b.stratum IN (SELECT stratum FROM strata) THEN b.stratum ELSE '' END AND b.bin >= f.cut),
k AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rejected_by FROM j GROUP BY 1)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rejected_by, '') AS rejected_by, NOT base_failed AND rejected_by IS NULL AS kept FROM m LEFT JOIN k ON k.doc_id = m.doc_id
"""


#: Texts failing by themselves and as copies, then every order's step by string tests on the letters a text fails.
OP11 = r"""
WITH g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN copy THEN 'E' ELSE '' END AS failed FROM t),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN g ON g.doc_id = f.doc_id GROUP BY 1, 2),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, k, 1) AS filter, substr(filter_order, 1, k - 1) AS before FROM o, range(1, 6) z(k)),
m AS (SELECT part, filter_order, step, filter, failed, n, good, toxic, contains(failed, filter) AS fails, translate(failed, before, '') <> failed AS gone FROM c, s),
r AS (SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = filter), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM m GROUP BY 1, 2, 3, 4)
SELECT r.*, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""

#: All scores of all anchors, ranked.
OP12 = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

#: Keys as they are, counted over distinct documents.
OP13 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM t),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(k.doc_id < top, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id, r
"""


ORACLES = {"op1_minhash": OP1, "op11_filter_audit": OP11, "op12_hard_negatives": OP12, "op13_line_dedup": OP13, "op2_licenses": _licenses(), "op3_sharding": _sharding(), "op8_quality": _quality()}
