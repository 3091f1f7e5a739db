"""DuckDB SQL fragments that say the same as the operators, written from their definitions."""

from __future__ import annotations

from ..operators.matching import GRID

K = 10


def records(lonely: bool = False) -> str:
    country = "CASE WHEN p_brand = 'Brand#13' THEN 'only-' || (p_partkey % 3 + 1) ELSE p_brand END" if lonely else "p_brand"
    return f"rec AS (SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_name AS business_name, p_size || ' ' || p_type || ' ' || p_brand AS business_address, {country} AS country, 'source' || (p_partkey % 3 + 1) AS source, p_partkey AS ord FROM part)"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"


def token_set(t: str) -> str:
    return f"list_distinct({tokens(t)})"


def grams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, len(' #' || {t} || '# ') - 1), lambda i: substr(' #' || lower({t}) || '# ', i, 3)))"


def feature_grams(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len({t}) - 2) + 1), lambda i: substr(' #' || lower({t}) || '# ', i, 3))) END"


def digits(t: str) -> str:
    return f"list_distinct(regexp_extract_all({t}, '\\p{{Nd}}+'))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


def compatible(a: str, b: str) -> str:
    return f"({a} IN ('', 'unknown') OR {b} IN ('', 'unknown') OR {a} = {b} OR contains({a}, {b}) OR contains({b}, {a}))"


PROFILE = f"prof AS (SELECT *, {token_set('business_name')} AS nt, {token_set('business_address')} AS at, {grams('business_name')} AS ng, {grams('business_address')} AS ag, {digits('business_address')} AS dg, lower(trim(country)) AS c FROM rec)"
SCORE = f"greatest({jaccard('l.nt', 'r.nt')}, {jaccard('l.at', 'r.at')}, {jaccard('l.ng', 'r.ng')}, {jaccard('l.ag', 'r.ag')}) + CASE WHEN list_has_any(l.dg, r.dg) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
SIDES = "l.source = 'source1' AND r.source <> 'source1'"
COLUMNS = f"l.entity_id AS s1_id, r.entity_id AS target_id, left(r.entity_id, 2) AS grp, {SCORE} AS score, l.ord AS l_ord, r.ord AS r_ord, l.business_name AS ln, r.business_name AS rn_, l.business_address AS la, r.business_address AS ra, l.country AS lc, r.country AS rc"
PAIRS = f"pairs AS (SELECT {COLUMNS} FROM prof l JOIN prof r ON {SIDES} AND {compatible('l.c', 'r.c')})"
CANDIDATES = f"cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, grp ORDER BY score DESC, r_ord, target_id) AS rn FROM pairs) WHERE rn <= {K})"
TRUTH = "truth AS (SELECT l.entity_id AS s1_id, r.entity_id AS target_id FROM rec l JOIN rec r ON l.source = 'source1' AND r.source <> 'source1' AND l.business_name = r.business_name AND l.country = r.country)"
BASE = f"WITH {records()}, {PROFILE}, {PAIRS}, {CANDIDATES}, {TRUTH}"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two texts by rows of its table."""
    codes = lambda t: f"list_transform(range(1, len({t}) + 1), lambda i: [unicode(substr({t}, i, 1))])"
    inner = f"list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j::INTEGER]), lambda nr, jj: list_append(nr, CASE WHEN unicode(substr({b}, jj[1], 1)) = ch[1] THEN row_[jj[1]] + 1 ELSE greatest(nr[jj[1]], row_[jj[1] + 1]) END), [0])"
    return f"list_reduce({codes(a)}, lambda row_, ch: {inner}, list_transform(range(0, len({b}) + 1), lambda z: 0))[-1]"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {lcs(a, b)} / (len({a}) + len({b})) END"


def text_features(name: str, left: str, right: str) -> str:
    """CTEs ``{name}1..3``: the five string features of the distinct text pairs among the candidates."""
    sort, sets = (lambda t: f"array_to_string(list_sort({tokens(t)}), ' ')"), (lambda t: f"list_sort({token_set(t)})")
    return f"""{name}1 AS (SELECT DISTINCT {left} AS x, {right} AS y FROM cand),
{name}2 AS (SELECT x, y, lower(x) AS lx, lower(y) AS ly, {sort('x')} AS sx, {sort('y')} AS sy, array_to_string({sets('x')}, ' ') AS ux, array_to_string({sets('y')}, ' ') AS uy,
 array_to_string(list_sort(list_intersect({token_set('x')}, {token_set('y')})), ' ') AS shared, {feature_grams('x')} AS gx, {feature_grams('y')} AS gy FROM {name}1),
{name}2b AS (SELECT *, trim(shared || ' ' || ux) AS wx, trim(shared || ' ' || uy) AS wy FROM {name}2),
{name}3 AS (SELECT x, y, CASE WHEN x = '' OR y = '' THEN 0.0 ELSE {ratio('lx', 'ly')} END AS lev, CASE WHEN x = '' OR y = '' THEN 0.0 ELSE jaro_winkler_similarity(lx, ly) END AS jw,
 CASE WHEN sx = '' OR sy = '' THEN 0.0 ELSE {ratio('sx', 'sy')} END AS sort_, CASE WHEN ux = '' OR uy = '' THEN 0.0 ELSE greatest({ratio('shared', 'ux')}, {ratio('shared', 'uy')}, {ratio('wx', 'wy')}) END AS set_, {jaccard('gx', 'gy')} AS tri FROM {name}2b)"""


DIGIT_JACCARD = jaccard("dl", "dr")
FEATURES = f"""{BASE}, {text_features('n', 'ln', 'rn_')}, {text_features('a', 'la', 'ra')},
cd AS (SELECT *, {digits('la')} AS dl, {digits('ra')} AS dr, lower(trim(lc)) AS c1, lower(trim(rc)) AS c2 FROM cand),
feat AS (SELECT c.s1_id, c.target_id, c.grp, c.rn, n.lev AS name_lev_ratio, n.jw AS name_jaro_winkler, n.sort_ AS name_token_sort, n.set_ AS name_token_set, n.tri AS name_trigram_jaccard,
 a.lev AS address_lev_ratio, a.jw AS address_jaro_winkler, a.sort_ AS address_token_sort, a.set_ AS address_token_set, a.tri AS address_trigram_jaccard,
 {DIGIT_JACCARD} AS address_digit_jaccard, CASE WHEN {DIGIT_JACCARD} = 1.0 THEN 1.0 ELSE 0.0 END AS address_digit_exact,
 CASE WHEN c1 = c2 AND c1 <> '' THEN 1.0 ELSE 0.0 END AS country_exact_match, CASE WHEN {compatible('c1', 'c2')} THEN 1.0 ELSE 0.0 END AS country_compatible,
 abs(len(ln) - len(rn_))::DOUBLE / greatest(1, len(ln), len(rn_)) AS name_len_diff, abs(len(la) - len(ra))::DOUBLE / greatest(1, len(la), len(ra)) AS addr_len_diff,
 CASE WHEN a.set_ > 0.85 OR a.tri > 0.8 THEN 1.0 ELSE 0.0 END AS high_addr_sim, CASE WHEN n.set_ > 0.85 OR n.jw > 0.85 THEN 1.0 ELSE 0.0 END AS high_name_sim,
 CASE WHEN c.target_id LIKE 'S2-%' THEN 1.0 ELSE 0.0 END AS is_target_s2, CASE WHEN c.target_id LIKE 'S3-%' THEN 1.0 ELSE 0.0 END AS is_target_s3
 FROM cd c JOIN n3 n ON c.ln = n.x AND c.rn_ = n.y JOIN a3 a ON c.la = a.x AND c.ra = a.y),
scored AS (SELECT *, (name_lev_ratio + name_trigram_jaccard + address_lev_ratio + address_trigram_jaccard + address_digit_jaccard + high_addr_sim + high_name_sim) / 7.0 AS score FROM feat)"""


def entity(predicted: str, keys: str) -> str:
    """CTE ``ent``: per key tp, sizes and P, R, F0.5."""
    return f"""cnt AS (SELECT k.s1_id, coalesce(any_value(p.n), 0) AS predicted, coalesce(any_value(t.n), 0) AS truth_n, coalesce(any_value(b.n), 0) AS tp FROM (SELECT DISTINCT s1_id FROM ({keys})) k
 LEFT JOIN (SELECT s1_id, count(DISTINCT target_id) AS n FROM {predicted} GROUP BY 1) p USING (s1_id) LEFT JOIN (SELECT s1_id, count(DISTINCT target_id) AS n FROM truth GROUP BY 1) t USING (s1_id)
 LEFT JOIN (SELECT s1_id, count(*) AS n FROM (SELECT s1_id, target_id FROM {predicted} INTERSECT SELECT s1_id, target_id FROM truth) GROUP BY 1) b USING (s1_id) GROUP BY 1),
ent AS (SELECT *, CASE WHEN predicted = 0 AND truth_n = 0 THEN 1.0 WHEN predicted = 0 OR truth_n = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS p, CASE WHEN predicted = 0 AND truth_n = 0 THEN 1.0 WHEN predicted = 0 OR truth_n = 0 THEN 0.0 ELSE tp::DOUBLE / truth_n END AS r FROM cnt),
f AS (SELECT *, CASE WHEN predicted = 0 AND truth_n = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END AS f0_5 FROM ent)"""


THRESHOLDS = ", ".join(f"({t!r}::DOUBLE)" for t in GRID)
