"""DuckDB SQL of the queries that SQL can express; each reads the same tables."""

import re

from . import licences, mixing
from .urlfilter import BAD, LEAST, MOST, PRIOR, RULES, SUFFIXES, SURE, TOP

OP1_SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least_id FROM p WHERE s IS NOT NULL GROUP BY s),
g AS (SELECT p.doc_id, p.i, p.word, max(CASE WHEN f.least_id < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS 49 PRECEDING) AS gone
      FROM p LEFT JOIN f ON p.s = f.s),
k AS (SELECT doc_id, sum(gone) AS n, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP2_DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw))),
o AS (SELECT dw.doc_id, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP10_SUFFIX_ARRAY = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS c, CASE WHEN 2 * (i + 50) <= length(h) THEN substr(h, 2 * i + 1, 100) END AS s
      FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least_id FROM p WHERE s IS NOT NULL GROUP BY s),
g AS (SELECT p.doc_id, p.i, p.c, max(CASE WHEN f.least_id < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS 49 PRECEDING) AS gone
      FROM p LEFT JOIN f ON p.s = f.s),
r AS (SELECT *, gone > coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS begins FROM g),
k AS (SELECT doc_id, sum(gone) AS n, count(*) FILTER (WHERE begins) AS spans, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP6_EMBEDDINGS = r"""
WITH RECURSIVE v AS (SELECT vec_id, x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_max([abs(c) for c in x]) > 0),
u AS MATERIALIZED (SELECT vec_id, [c / m for c in x] AS x FROM (SELECT vec_id, x, list_max([abs(c) for c in x]) AS m FROM v)),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.vec_id, coalesce(n, 0) AS n_links, c.component_id, w.vec_id = c.component_id AS kept
FROM embeddings w LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON w.vec_id = l.a JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON w.vec_id = c.a
"""


def op9_urls() -> str:
    """The reputation in three levels, written out; the posterior's distribution function as its power series."""
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    two = "(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"

    def strength(level: str) -> str:
        noise = "n * prior * (1 - prior)"
        spread = f"(sum(pow(bad - n * prior, 2) - {noise}) / sum(n * (n - 1)))"
        return f"m_{level} AS (SELECT CASE WHEN sum(n) = 0 OR sum(n * (n - 1)) = 0 OR sum(pow(bad - n * prior, 2) - {noise}) <= 0 THEN {MOST} ELSE round(greatest({LEAST}, least({MOST}, sum({noise}) / sum(n) / {spread} - 1)), 6) END AS m FROM l_{level})"

    mean = "(bad + m * prior) / (n + m)"
    series = f"list_sum([exp(k * ln({BAD}) + lgamma(a + b + k) - lgamma(a + b) - lgamma(a + 1 + k) + lgamma(a + 1)) for k in range(0, 4000)])"
    return f"""
WITH t AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT page_id, translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM t),
q AS (SELECT *, string_split(host, '.') AS s, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN {two} AS two FROM h),
p AS (SELECT page_id, host, path, array_to_string(list_slice(s, CASE WHEN two THEN -3 ELSE -2 END, -1), '.') AS domain, array_to_string(list_slice(s, CASE WHEN two THEN -2 ELSE -1 END, -1), '.') AS suffix FROM q),
o AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT host, domain, suffix, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY ALL),
l_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + {PRIOR * TOP!r}) / (sum(n) + {TOP}) FROM c) AS prior FROM c GROUP BY suffix), {strength("suffix")},
l_domain AS (SELECT c.domain, c.suffix, sum(c.n) AS n, sum(c.bad) AS bad, any_value(s.prior) AS prior FROM c JOIN (SELECT suffix, {mean} AS prior FROM l_suffix, m_suffix) s ON c.suffix = s.suffix GROUP BY ALL), {strength("domain")},
l_host AS (SELECT c.host, c.domain, sum(c.n) AS n, sum(c.bad) AS bad, any_value(s.prior) AS prior FROM c JOIN (SELECT domain, {mean} AS prior FROM l_domain, m_domain) s ON c.domain = s.domain GROUP BY ALL), {strength("host")},
b AS (SELECT host, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM l_host, m_host),
r AS (SELECT host, 1 - exp(a * ln({BAD}) + b * ln({1 - BAD}) + lgamma(a + b) - lgamma(a) - lgamma(b) - ln(a)) * {series} AS sure FROM b),
v AS (SELECT *, CASE {rules} END AS best FROM p LEFT JOIN r USING (host))
SELECT page_id, host, path, string_split(best, ' ')[2] AS rule, coalesce(string_split(best, ' ')[1], CASE WHEN sure >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SIZE = 1 << 64


def _num(n: int) -> str:
    return f"{n}::UHUGEINT"


def _mul(x: str, n: int) -> str:
    return f"(({x}) * {_num(n)} % {_num(SIZE)})"


def _add(x: str, y: str) -> str:
    return f"((({x}) + ({y})) % {_num(SIZE)})"


def _rot(x: str, r: int) -> str:
    """A rotation by r is a product with 2^r modulo 2^64 - 1."""
    return f"(({x}) * {_num(1 << r)} % {_num(SIZE - 1)})"


def _lane(acc: str, word: str) -> str:
    return _mul(_rot(_add(acc, _mul(word, P2)), 31), P1)


def _let(x: str, body: str) -> str:
    """body, in which y stands for x."""
    return f"list_transform([{x}], lambda y: {body})[1]"


def _final(x: str) -> str:
    x = _let(x, _mul(f"xor(y, y // {_num(1 << 33)})", P2))
    x = _let(x, _mul(f"xor(y, y // {_num(1 << 29)})", P3))
    return _let(x, f"xor(y, y // {_num(1 << 32)})")


def _hash_long(x: str, seed: str) -> str:
    return _final(_add(_mul(_rot(f"xor({_add(seed, _num((P5 + 8) % SIZE))}, {_lane(_num(0), x)})", 27), P1), _num(P4)))


def _hash_int(n: int, seed: str) -> str:
    return _final(_add(_mul(_rot(f"xor({_add(seed, _num((P5 + 4) % SIZE))}, {_num(n * P1 % SIZE)})", 23), P2), _num(P3)))


def _xxh64(source: str, key: str) -> str:
    """CTEs that end in x5 (key, h): the XXH64 of the bytes that b holds in hex, with seed, for the rows (key, b, seed) of source;
    128-bit integers, in steps over lists."""

    def word(text: str, at: str, n: int) -> str:
        return "('0x' || " + " || ".join(f"substr({text}, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"

    start = ", ".join(_add("seed", _num(x % SIZE)) for x in (P1 + P2, P2, 0, -P1))
    stripes = f"list_reduce([[{start}]] || [[{', '.join(word('q', str(8 * k), 8) for k in range(4))}] for q in regexp_extract_all(b, '.{{64}}')], lambda v, x: [{', '.join(_lane(f'v[{k}]', f'x[{k}]') for k in (1, 2, 3, 4))}])"
    whole = _add(_add(_rot("v[1]", 1), _rot("v[2]", 7)), _add(_rot("v[3]", 12), _rot("v[4]", 18)))
    for k in (1, 2, 3, 4):
        whole = _add(_mul(f"xor({whole}, {_lane(_num(0), f'v[{k}]')})", P1), _num(P4))
    eights = f"list_reduce([{_add('h', 'n::UHUGEINT')}] || [{word('b', 'i', 8)} for i in range(0, n % 32 - 7, 8)], lambda h, x: {_add(_mul(_rot(f'xor(h, {_lane(_num(0), chr(120))})', 27), P1), _num(P4))})"
    fours = f"CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rot('xor(h, ' + _mul(word('b', 'n % 32 - n % 8', 4), P1) + ')', 23), P2), _num(P3))} ELSE h END"
    ones = f"list_reduce([h] || [{word('b', 'i', 1)} for i in range(n % 32 - n % 4, n % 32)], lambda h, x: {_mul(_rot(f'xor(h, {_mul(chr(120), P5)})', 11), P1)})"
    return f"""x0 AS MATERIALIZED (SELECT {key}, b, n, seed, {stripes} AS v FROM (SELECT *, length(b) // 2 AS n FROM {source})),
x1 AS MATERIALIZED (SELECT {key}, substr(b, 2 * (n - n % 32) + 1) AS b, n, CASE WHEN n >= 32 THEN {whole} ELSE {_add('seed', _num(P5))} END AS h FROM x0),
x2 AS MATERIALIZED (SELECT {key}, b, n, {eights} AS h FROM x1),
x3 AS MATERIALIZED (SELECT {key}, b, n, {fours} AS h FROM x2),
x4 AS MATERIALIZED (SELECT {key}, {ones} AS h FROM x3),
x5 AS MATERIALIZED (SELECT {key}, {_final('h')} AS h FROM x4)"""


def op4_simhash() -> str:
    bits = " + ".join(f"(CASE WHEN 2 * sum((h >> {k}) & 1) > count(*) THEN {1 << k} ELSE 0 END)::UBIGINT" for k in range(64))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
t AS (SELECT s, hex(encode(s)) AS b, 42::UHUGEINT AS seed FROM (SELECT DISTINCT s FROM s)),
{_xxh64("t", "s")},
x AS MATERIALIZED (SELECT s, h::UBIGINT AS h FROM x5),
p AS (SELECT r, {bits} AS fp FROM s JOIN x USING (s) GROUP BY r),
f AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN p USING (r)),
n AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM n a JOIN n b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
c AS (SELECT fp AS a, fp AS b FROM n UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id
FROM f JOIN (SELECT c.a, min(n.least) AS component_id FROM c JOIN n ON c.b = n.fp GROUP BY c.a) g ON f.fp = g.a
"""


def op7_mixing(seed: int = 17, levels: int = 3) -> str:
    """Targets by the sources' order of stopping; then three levels of the tree, enough for FAN ** 3 rows (a level too many changes
    nothing). Rows that repeat id, source and text could be told apart by nothing and are not expected."""
    fan, half = mixing.FAN, _num(1 << 63)

    def uniform(h: str) -> str:
        return f"(({h}) % {_num(1 << 40)})::DOUBLE / {1 << 40}::DOUBLE"

    one = "1::DOUBLE"
    next_a = f"CASE WHEN to_a THEN CASE WHEN ({one} - pa) * sa <= pb * sb THEN {one} ELSE pa + ga / sa END ELSE CASE WHEN pa * sa <= ({one} - pb) * sb THEN 0::DOUBLE ELSE pa - gb / sa END END"
    next_b = f"CASE WHEN to_a THEN CASE WHEN pb * sb <= ({one} - pa) * sa THEN 0::DOUBLE ELSE pb - ga / sb END ELSE CASE WHEN ({one} - pb) * sb <= pa * sa THEN {one} ELSE pb + gb / sb END END"

    def named(x: str) -> str:
        """The short names above as fields of the fold's a and x, and of y."""
        for short, full in (("to_a", "(x['draw'] * (y['ga'] + y['gb']) < y['gb'])"), ("pa", "a['p']"), ("pb", "x['p']"), ("sa", "a['size']"), ("sb", "x['size']"), ("ga", "y['ga']"), ("gb", "y['gb']")):
            x = re.sub(rf"(?<!['\w]){short}(?!['\w])", lambda _, full=full: full, x)
        return x

    gains = named(f"{{'ga': least(({one} - pa) * sa, pb * sb), 'gb': least(pa * sa, ({one} - pb) * sb)}}")
    moved = _let(gains, f"{{'a': {named(next_a)}, 'b': {named(next_b)}}}")
    ended = {k: f"(y['{k}'] <= 0 OR y['{k}'] >= 1)" for k in "ab"}
    done = "a['done']" + "".join(f" || CASE WHEN {ended[k]} THEN [{{'r': {v}['r'], 'extra': y['{k}']::INTEGER}}] ELSE [] END" for k, v in (("a", "a"), ("b", "x")))
    open_row = {f: f"CASE WHEN NOT {ended['a']} THEN {pa} WHEN NOT {ended['b']} THEN {pb} END" for f, pa, pb in (("r", "a['r']", "x['r']"), ("size", "a['size']", "x['size']"), ("p", "y['a']", "y['b']"), ("draw", "a['draw']", "x['draw']"))}
    paired = _let(moved, "{'done': " + done + "".join(f", '{f}': {v}" for f, v in open_row.items()) + "}")
    step = f"CASE WHEN a['r'] IS NULL THEN {{'done': a['done'], 'r': x['r'], 'size': x['size'], 'p': x['p'], 'draw': x['draw']}} ELSE {paired} END"
    tree, parts, buckets = [], [], f"greatest(1, ceil(n / {fan})::BIGINT)"
    for k in range(levels):
        h, draw = _hash_int(k, _hash_int(seed, "own")), uniform(_hash_int(k, _hash_int(seed + 1, "own")))
        signed = f"(b::HUGEINT - CASE WHEN b >= {half} THEN {SIZE}::HUGEINT ELSE 0::HUGEINT END)"
        tree.append(f"""g{k} AS MATERIALIZED (SELECT source, r, size, p, h, draw, (({signed} % buckets) + buckets) % buckets AS bucket
  FROM (SELECT source, r, size::DOUBLE AS size, p, {h} AS h, {draw} AS draw, {_hash_int(seed, 'own')} AS b, (SELECT {buckets} FROM total) AS buckets FROM o{k})),
z{k} AS MATERIALIZED (SELECT source, list_reduce(list({{'done': []::STRUCT(r BIGINT, extra INTEGER)[], 'r': r, 'size': size, 'p': p, 'draw': draw}} ORDER BY xor(h, {half})), lambda a, x: {step}) AS z FROM g{k} GROUP BY source, bucket),
o{k + 1} AS MATERIALIZED (SELECT z{k}.source, rows.r, rows.size, z['p'] AS p, rows.own FROM z{k} JOIN rows ON rows.r = z['r'])""")
        parts.append(f"SELECT e['r'] AS r, e['extra'] AS extra FROM (SELECT unnest(z['done']) AS e FROM z{k})")
        buckets = f"ceil({buckets} / {fan})::BIGINT"
    last = uniform(_hash_int(seed + 2, "own"))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
total AS (SELECT count(*) AS n FROM d),
i AS MATERIALIZED (SELECT r, source, text, CASE WHEN doc_id IS NULL THEN {_num(42)} ELSE {_hash_long(f"((doc_id::HUGEINT + {SIZE}::HUGEINT) % {SIZE}::HUGEINT)::UHUGEINT", _num(42))} END AS seed FROM d),
q AS MATERIALIZED (SELECT r, 0 AS part, hex(encode(source)) AS b, seed FROM i WHERE source IS NOT NULL),
{_xxh64("q", "r")},
i2 AS MATERIALIZED (SELECT i.r, text, coalesce(x5.h, seed) AS seed FROM i LEFT JOIN x5 USING (r)),
q2 AS MATERIALIZED (SELECT r, hex(encode(text)) AS b, seed FROM i2 WHERE text IS NOT NULL),
{re.sub(r"x([0-5])(?![0-9A-Fa-f])", r"w_\1", _xxh64("q2", "r"))},
u AS MATERIALIZED (SELECT i2.r, {_hash_long("coalesce(w_5.h, seed)", _num(42))} AS own FROM i2 LEFT JOIN w_5 USING (r)),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 3::DOUBLE AS cap, ([1, 2, 3])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM s0),
s2 AS (SELECT *, cap / weight AS stops, sum(source_size) OVER () AS whole FROM s1),
s3 AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY stops, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY stops, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS MATERIALIZED (SELECT source, source_size, least(cap, coalesce((SELECT level FROM s3 WHERE level <= stops ORDER BY stops, source NULLS LAST LIMIT 1) * weight, cap)) AS target FROM s3),
rows AS MATERIALIZED (SELECT d.r, d.doc_id, d.source, d.size, source_size, target, own, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM d JOIN u USING (r) JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
o0 AS MATERIALIZED (SELECT source, r, size, ratio - floor(ratio) AS p, own FROM rows WHERE ratio > floor(ratio) AND size > 0),
{", ".join(tree)},
t AS ({" UNION ALL ".join(parts)} UNION ALL SELECT r, ({last} < p)::INTEGER FROM o{levels})
SELECT doc_id, source, size, source_size, target, (size * (floor(ratio)::BIGINT + coalesce(t.extra, 0)))::BIGINT AS taken FROM rows LEFT JOIN t USING (r)
"""


def op8_licences() -> str:
    """Canonical texts by lines and words: notices are lines that match and, as SQL has no lookahead, are no excepted ones."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def texts(x: list[str]) -> str:
        return "[" + ", ".join(text(v) for v in x) + "]"

    mark = r"^[ \t#*;%/!|>-]*(?:<!--[ \t]*|(?i:dnl|rem)[ \t]+)?"
    year = r"(?:19|20)[0-9]{2}\b"
    dated = rf"(?i:(?:portions[ \t]+)?copyright(?:ed)?)[ \t:,]*(?:(?i:by)[ \t]+)?(?:(?i:\(c\)|©|&copy;|[<\[{{(]?(?:yyyy|year)\b)|[<\[{{(]?{year})"
    sign = rf"(?i:\(c\)|&copy;)[ \t,]*(?:(?i:copyright)\b|{year})|©"
    holder = r"Copyright[ \t:]+(?:by[ \t]+)?"
    other = r"(?i:licen[sc]e|notice|holder|owner|law|act|office|right|interest|and|or|statement|treat)(?i:s|y|ies|ed)?\b"
    reserved = r"(?i:all rights reserved)[ \t.!*/\r]*$"

    def notice(line: str) -> str:
        has = lambda p: f"regexp_matches({line}, {text(mark + p)})"
        return f"({has(f'(?:{dated}|{sign}|{reserved})')} OR ({has(holder + chr(92) + 'p{Lu}')} AND NOT {has(holder + other)}))"

    spelt = " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in licences.SPELLINGS)

    def canonical(x: str) -> str:
        kept = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT {notice('l')}), chr(10))"
        return f"array_to_string(list_transform(regexp_extract_all(lower({kept}), {text('[^' + licences.PUNCTUATION[1:])}), lambda w: CASE w {spelt} ELSE w END), ' ')"

    parts = [(n, [""], [t], [""]) for n, t in licences.KNOWN] + licences.standard_texts()
    known = ",\n".join(f"({text(n)}, {texts(a)}, {texts(b)}, {texts(c)})" for n, a, b, c in parts)
    return f"""
WITH k0(license, a, b, c) AS (VALUES {known}),
k1 AS (SELECT license, a, b, unnest(c) AS c FROM (SELECT license, a, unnest(b) AS b, c FROM (SELECT license, unnest(a) AS a, b, c FROM k0))),
k2 AS (SELECT license, unnest([t, replace(t, 'https://', 'http://'), replace(t, 'http://', 'https://')]) AS t FROM (SELECT license, a || chr(10) || b || c AS t FROM k1)),
k AS MATERIALIZED (SELECT sha256({canonical('t')}) AS digest, min(license) AS license FROM (SELECT DISTINCT license, t FROM k2) GROUP BY 1),
d AS MATERIALIZED (SELECT doc_id, text, sha256({canonical('text')}) AS digest FROM documents),
l AS (SELECT DISTINCT doc_id, digest, unnest(string_split(text, chr(10))) AS line FROM d),
m AS MATERIALIZED (SELECT line, license FROM (SELECT line, sha256({canonical('line')}) AS digest FROM (SELECT DISTINCT line FROM l)) JOIN k USING (digest)),
n AS (SELECT doc_id, digest, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN m USING (line) GROUP BY ALL)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.digest = n.digest
"""
