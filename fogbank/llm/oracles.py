"""SQL that computes whole query results independently, where SQL can."""

from __future__ import annotations

from fogbank.llm.seeds import AGREE, MASKS, SPAN
from fogbank.llm.spots import ANCHORS, CHAIN, DIGITS, RATIO, REACH

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_MASKS = ", ".join(f"({m}, [{', '.join(map(str, mask))}], {max(mask)})" for m, mask in enumerate(MASKS))

DECONTAMINATE = f"""
WITH masks(m, offs, reach) AS (VALUES {_MASKS}),
d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents),
a AS (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark),
b AS (SELECT * FROM a WHERE len(t) >= 8),
few AS (SELECT DISTINCT item_id, t FROM a WHERE len(t) BETWEEN 1 AND 7),
short AS (SELECT DISTINCT doc_id, item_id, len(few.t) AS n FROM few, d
          WHERE contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(few.t, ' ') || ' ')),
dp AS (SELECT doc_id, t, m, offs, unnest(range(1, len(t) - reach + 1)) AS i FROM d, masks),
bp AS (SELECT item_id, t, m, offs, unnest(range(1, len(t) - reach + 1)) AS i FROM b, masks),
ds AS (SELECT doc_id, m, i, list_transform(offs, lambda k: t[i + k]) AS key FROM dp),
bs AS (SELECT item_id, m, i, list_transform(offs, lambda k: t[i + k]) AS key FROM bp),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.i AS diagonal FROM ds JOIN bs ON ds.m = bs.m AND ds.key = bs.key),
places AS (SELECT h.doc_id, h.item_id, diagonal, d.t AS dt, b.t AS bt, unnest(range(1, len(b.t) + 1)) AS j
           FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
same AS (SELECT doc_id, item_id, diagonal, j, len(bt) AS n, least(len(bt), {SPAN}) AS wide,
         CASE WHEN diagonal + j BETWEEN 1 AND len(dt) AND dt[diagonal + j] = bt[j] THEN 1 ELSE 0 END AS s FROM places),
runs AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS got
         FROM same)
SELECT doc_id, item_id, CAST(max(got) AS BIGINT) AS n_matched, CAST(max(wide) AS BIGINT) AS n_compared
FROM runs WHERE j <= n - wide + 1 AND got >= ceil({AGREE} * wide) GROUP BY doc_id, item_id
UNION ALL SELECT doc_id, item_id, CAST(n AS BIGINT), CAST(n AS BIGINT) FROM short
"""

LINE_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS ws FROM d),
tri AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
again AS (SELECT doc_id, unnest(list(i)) AS i FROM (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM tri) GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS t(o) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, text, line, {_WORDS.format('line')} AS ws FROM ln),
ok AS (SELECT doc_id, host, text, line, len(ws) AS n,
       regexp_replace(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g') AS k
       FROM lw WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ok GROUP BY doc_id),
freq AS (SELECT host, k, count(DISTINCT text) AS docs FROM ok GROUP BY host, k),
every AS (SELECT k, count(DISTINCT text) AS docs FROM ok GROUP BY k),
gone AS (SELECT o.doc_id, sum(o.n) AS n FROM ok o JOIN freq f ON o.host = f.host AND o.k = f.k JOIN every e ON o.k = e.k
         WHERE f.docs > 10 OR e.docs > 30 GROUP BY o.doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
      coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed
      FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_removed AS BIGINT) AS n_removed,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_removed > 0.7 * n_words AS kept
FROM m
"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS ws FROM d),
low AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN low.low < w.doc_id THEN 'E' ELSE '' END AS fails
      FROM w JOIN low ON low.text = w.text LEFT JOIN lab ON lab.doc_id = w.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, substring(o, s, 1) AS own, substring(o, 1, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
met AS (SELECT part, o, s, own, fails, n, good, toxic, contains(fails, own) AS fail, translate(before, fails, '') <> before AS early FROM steps, cells),
gone AS (SELECT part, o, own, sum(CASE WHEN fail AND NOT early THEN n ELSE 0 END) AS removed FROM met GROUP BY part, o, own),
share AS (SELECT part, own, sum(removed) AS shapley FROM gone GROUP BY part, own)
SELECT met.part, o AS filter_order, CAST(s AS INTEGER) AS step,
       CAST(sum(CASE WHEN NOT fail AND NOT early THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fail AND NOT early THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN fail AND early THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = met.own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN fail AND NOT early THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN fail AND NOT early THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost, CAST(any_value(shapley) AS BIGINT) AS shapley
FROM met JOIN share ON share.part = met.part AND share.own = met.own GROUP BY met.part, o, s
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
m AS (SELECT doc_id, 100 - 75 + (75 * len(ts) * s.n) // s.l AS m FROM d, s WHERE len(ts) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS t FROM benchmark) GROUP BY item_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, s WHERE t IN (SELECT t FROM q) GROUP BY t),
r AS (SELECT item_id, tf.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w ON w.t = q.t JOIN tf ON tf.t = q.t JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""


def _sigs(name: str, text: str, source: str) -> str:
    """Views that end in ``name`` with the columns of ``source`` and ``s``, the sorted set of the signatures of ``text``."""
    anchors = "[" + ", ".join(f"'{a}'" for a in ANCHORS) + "]"
    chain = ", ".join(f"c[i - j + {1 + k}]" for k in range(CHAIN))
    return f"""{name}_w AS (SELECT *, {_TOKENS.format(text)} AS w FROM {source}),
{name}_c AS (SELECT *, list_filter(w, lambda x: NOT list_contains({anchors}, x)) AS c,
             list_filter(range(1, len(w) + 1), lambda i: list_contains({anchors}, w[i])) AS a FROM {name}_w),
{name}_s AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(a, lambda i, j: CASE WHEN i - j < len(c)
             THEN left(md5(concat_ws(' ', w[i], {chain})), {DIGITS}) END), lambda x: x IS NOT NULL))) AS found FROM {name}_c),
{name} AS (SELECT * EXCLUDE (w, c, a, found), CASE WHEN len(found) > 0 THEN found WHEN len(w) > 0 THEN [left(md5(array_to_string(w, ' ')), {DIGITS})]
           ELSE [] END AS s FROM {name}_s)"""


def _likeness(a: str, b: str) -> str:
    part = lambda x: f"floor(ln(len({x})) / ln({1 / RATIO}))"
    return f"""CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0
    WHEN abs({part(a)} - {part(b)}) > {REACH} THEN 0.0
    ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"""


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sigs('own', 't', 'd')},
n AS (SELECT doc_id, t, s, coalesce(lead(struct_pack(t := t, s := s)) OVER (ORDER BY doc_id DESC), first(struct_pack(t := t, s := s)) OVER (ORDER BY doc_id DESC)) AS x FROM own),
e AS (SELECT doc_id, t, s AS so, x.s AS sn, left(t, length(t) - length(t) // 2) || left(x.t, length(t) // 2) AS et FROM n),
{_sigs('ed', 'et', 'e')}
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, array_to_string(so, '') AS fingerprint,
       array_to_string(s, '') AS edited_fingerprint, {_likeness('so', 's')} AS near_edited, {_likeness('so', 'sn')} AS near_next,
       CAST(len(so) AS BIGINT) AS n_signatures
FROM ed
"""
