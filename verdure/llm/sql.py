"""DuckDB SQL for the operators that SQL can express: operators 1, 5, 9, 11 and 13."""

from __future__ import annotations

from .quality import CLASSES, FEWEST, MAX_CHAR_JSD, MAX_WORD_JSD, MIN_WORDS, RAREST, TOP

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER v AS g, count(*) OVER v AS n FROM w
  WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY g, n ORDER BY doc_id, i) > 1 AS later FROM g),
r AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT d.doc_id, len(ws) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d
LEFT JOIN (SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS g FROM p),
f AS (SELECT doc_id, i, b, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS later FROM s),
r AS (SELECT doc_id, i, b, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT doc_id, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM r)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(k.n, 0) AS n_removed, coalesce(k.runs, 0) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256 FROM d
LEFT JOIN (SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) AS BIGINT) AS runs,
  string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""

_SETS = {
    "upper": "A-Z", "lower": "a-z", "digit": "0-9", "space": r"\x20\x09-\x0D", "symbol": "#*$%&|<>",
    "punct": r"!\x22\x27()+,./:;=?@\[\\\]^_`{}~\-",
}


def _count(name: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{_SETS[name]}]', '', 'g'))"


def _term(a: str, b: str) -> str:
    part = "CASE WHEN {a} > 0 THEN ({a}) * log2(2 * ({a}) / (({a}) + ({b}))) ELSE 0 END"
    return f"({part.format(a=a, b=b)} + {part.format(a=b, b=a)}) / 2"


def quality() -> str:
    chars = " + ".join(_term(f"(m.c_{c} * 1.0 / m.c_total)", f"r.rc_{c}") for c in CLASSES)
    line = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
    return f"""
WITH d AS (SELECT doc_id, lang, text, {_WORDS} AS ws FROM documents),
c AS (SELECT doc_id, lang, len(ws) AS n, length(coalesce(text, '')) AS c_total, {", ".join(f"{_count(k)} AS c_{k}" for k in _SETS)}, len({line}) - len(list_distinct({line})) AS dup FROM d),
w AS (SELECT doc_id, lang, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER v || ' ' || lead(word, 2) OVER v AS g FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g),
x AS (SELECT doc_id, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS repeated FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM t) GROUP BY doc_id),
m AS (SELECT c.*, c_total - ({" + ".join(f"c_{k}" for k in _SETS)}) AS c_other, CAST(coalesce(repeated, 0) AS BIGINT) AS rep, n < 50 OR 100 * coalesce(repeated, 0) > 50 * n AS failed FROM c LEFT JOIN x ON x.doc_id = c.doc_id),
z AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {FEWEST} AND count(*) * {RAREST} >= (SELECT count(*) FROM documents)),
v AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM w WHERE lang IN (FROM z) GROUP BY lang, word),
k AS (SELECT w.doc_id, v.lang, v.place, count(*) AS c FROM w JOIN v ON v.lang = w.lang AND v.word = w.word AND v.place <= {TOP} GROUP BY 1, 2, 3),
r AS (SELECT lang, sum(n) AS rn, {", ".join(f"sum(c_{c}) * 1.0 / sum(c_total) AS rc_{c}" for c in CLASSES)} FROM m WHERE NOT failed AND lang IN (FROM z) GROUP BY lang),
q AS (SELECT k.lang, k.place, sum(c) * 1.0 / any_value(rn) AS q FROM k JOIN m ON m.doc_id = k.doc_id AND NOT m.failed JOIN r ON r.lang = k.lang GROUP BY 1, 2),
o AS (SELECT r.lang, 1 - coalesce(sum(q.q), 0) AS q_other FROM r LEFT JOIN q ON q.lang = r.lang GROUP BY r.lang),
p AS (SELECT k.doc_id, sum(c) AS held, sum(coalesce(q.q, 0)) AS q_held, sum({_term("(c * 1.0 / m.n)", "coalesce(q.q, 0)")}) AS terms FROM k JOIN m ON m.doc_id = k.doc_id LEFT JOIN q ON q.lang = k.lang AND q.place = k.place GROUP BY 1),
j AS (SELECT m.*, CASE WHEN m.n >= {MIN_WORDS} AND r.lang IS NOT NULL THEN sqrt(greatest(0, {chars})) END AS jc, CASE WHEN m.n >= {MIN_WORDS} AND r.lang IS NOT NULL THEN
  sqrt(greatest(0, coalesce(terms, 0) + (1 - q_other - coalesce(q_held, 0)) / 2 + {_term("((m.n - coalesce(held, 0)) * 1.0 / m.n)", "q_other")})) END AS jw
  FROM m LEFT JOIN r ON r.lang = m.lang LEFT JOIN o ON o.lang = m.lang LEFT JOIN p ON p.doc_id = m.doc_id)
SELECT doc_id, n AS n_words, c_total - c_space AS word_chars, c_symbol AS n_symbols, dup AS n_dup_lines, rep AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (coalesce(jc, 0) > {MAX_CHAR_JSD} OR coalesce(jw, 0) > {MAX_WORD_JSD}) AS kept, jc AS jsd_chars, jw AS jsd_words FROM j
"""


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for ch in regexp_extract_all(CAST(doc_id AS VARCHAR), '.')])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def merkle(levels: int = 5, top: int = 3) -> str:
    """Enough levels for 16 ** levels documents of a source and 16 ** top sources; a tree that has its root goes on unchanged."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {leaf(lowered)} END AS found FROM documents)",
        "d0 AS (SELECT doc_id, leaf, coalesce(found, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t FROM l)",
        "s0 AS (SELECT t, i, leaf AS d, count(*) OVER (PARTITION BY t) AS c FROM d0)",
    ]
    for k in range(levels + top):
        if k == levels:
            parts.append(f"s{k} AS (SELECT 0 AS t, t AS i, d, count(*) OVER () AS c FROM s{k}x)")
            parts.append(f"d{k} AS (SELECT e.* REPLACE (0 AS t, e.t AS i), x.d AS subroot FROM d{k}x e JOIN s{k}x x ON x.t = e.t)")
        end = "x" if k + 1 == levels else ""
        parts.append(f"g{k} AS (SELECT t, i // 16 AS i, c, list(d ORDER BY i) AS ds FROM s{k} GROUP BY t, i // 16, c)")
        parts.append(f"s{k + 1}{end} AS (SELECT t, i, CASE WHEN c = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (c + 15) // 16 AS c FROM g{k})")
        parts.append(f"h{k} AS (SELECT d.*, c, array_to_string(ds[1:d.i % 16], '') AS lt, array_to_string(ds[d.i % 16 + 2:], '') AS rt FROM d{k} d JOIN g{k} g ON g.t = d.t AND g.i = d.i // 16)")
        parts.append(f"d{k + 1}{end} AS (SELECT * EXCLUDE (lt, rt, c) REPLACE (i // 16 AS i, CASE WHEN c = 1 THEN f ELSE sha256(lt || f || rt) END AS f, CASE WHEN c = 1 THEN proof ELSE proof || lt || rt END AS proof) FROM h{k})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, s.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s.d AS verified FROM d{levels + top} d JOIN s{levels + top} s ON s.t = d.t"


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKING = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM p),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, nn),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN p USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""
