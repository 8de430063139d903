"""SQL (DuckDB) that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

import re

from millrace.llm import licenses, merkle, mixing, quality

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({{}}, '{_SPACE}'), lambda w: w <> '')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql() -> str:
    says = lambda phrases: f"regexp_matches(lower(line), {_text(quality.whole_words(phrases))})"
    fails = f"{says(quality.BOILERPLATE)} OR (len(w) < {quality.SHORT_CUE} AND {says(quality.CUES)}) OR (regexp_matches(line, '[{{}}]') AND regexp_matches(rtrim(line), '[{{}};]$'))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS k FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, line, {_WORDS.format("line")} AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT *, len(w) > 0 AND ({fails} OR (len(w) < {quality.SHORT_LINE} AND NOT regexp_matches(rtrim(line), {_text(quality.CLOSING)})) OR len(regexp_extract_all(line, '{quality.SYMBOLS}')) * 100 > len(w) * {quality.MOST_SYMBOLS_PERCENT}
  OR (b >= 2 AND b * 100 >= len(w) * {quality.NAV_PERCENT})) AS fails FROM (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, {_text(quality.SEPARATOR)}))) AS b FROM l)),
s AS (SELECT doc_id, count(*) FILTER (WHERE len(w) > 0) AS n_lines, count(*) FILTER (WHERE len(w) > 0) - count(DISTINCT line) FILTER (WHERE len(w) > 0) AS n_dup, count(*) FILTER (WHERE fails) AS n_failed, coalesce(sum(len(w)) FILTER (WHERE NOT fails), 0) AS left_words FROM f GROUP BY doc_id),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_lines::INT AS n_lines, n_failed::INT AS n_failed_lines, left_words FROM d JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT 100 * (n_words - left_words) > {quality.MOST_LOST_PERCENT} * n_words AS kept, n_lines, n_failed_lines FROM b"""


def licenses_sql() -> str:
    rows, shingles = [], []
    for name, notice in sorted(licenses.NOTICES.items()):
        ws = [w for w in re.split(licenses.GAP, notice.lower()) if w]
        q = min(licenses.SHINGLE, len(ws))
        items = [" ".join(ws[j : j + q]) for j in range(len(ws) - q + 1)]
        rows.append(f"({_text(name)}, {q}, {len(items)}, {len(set(items))})")
        shingles += [f"({_text(name)}, {_text(x)})" for x in sorted(set(items))]
    return f"""WITH t(template, q, s, size) AS (VALUES {", ".join(rows)}), ts(template, gram) AS (VALUES {", ".join(shingles)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{licenses.GAP}'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, w, q, unnest(range(1, len(w) - q + 2)) AS i FROM d, (SELECT DISTINCT q FROM t)), g AS (SELECT doc_id, q, len(w) AS n, i - 1 AS pos, array_to_string(w[i:i + q - 1], ' ') AS gram FROM p),
h AS (SELECT doc_id, template, pos, g.gram, s, size, n - g.q + 1 AS grams FROM g JOIN ts USING (gram) JOIN t USING (template) WHERE t.q = g.q),
st AS (SELECT DISTINCT doc_id, template, s, size, unnest(range(greatest(0, pos - s + 1), least(pos, grams - s) + 1)) AS start FROM h),
c AS (SELECT st.doc_id, st.template, st.start, st.size, count(DISTINCT h.gram) AS k FROM st JOIN h ON h.doc_id = st.doc_id AND h.template = st.template AND h.pos >= st.start AND h.pos < st.start + st.s GROUP BY ALL),
v AS (SELECT *, k / size::DOUBLE AS containment, row_number() OVER (PARTITION BY doc_id, template ORDER BY k DESC, start) AS r FROM c WHERE 100 * k >= {licenses.PERCENT} * size)
SELECT doc_id, template, max(containment) AS containment, (min(start) FILTER (WHERE r = 1))::BIGINT AS first_word, count(*) AS n_windows FROM v GROUP BY doc_id, template"""


def mixing_sql() -> str:
    steps = [f"x1 AS (SELECT source, id, size, v, room FROM due JOIN room USING (k) WHERE size > 0 AND part > 0 AND size <= room)"]
    for n in range(1, mixing.PASSES + 1):
        steps.append(f"y{n} AS (SELECT * FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS upto FROM x{n}) WHERE upto <= room)")
        if n < mixing.PASSES:
            steps.append(f"z{n} AS (SELECT coalesce(source, chr(1)) AS k, sum(size) AS used FROM y{n} GROUP BY 1), x{n + 1} AS (SELECT * FROM (SELECT source, id, size, v, room - coalesce(used, 0) AS room FROM x{n} LEFT JOIN z{n} ON coalesce(x{n}.source, chr(1)) = z{n}.k ANTI JOIN y{n} USING (id)) WHERE size <= room)")
    taken = " UNION ALL ".join(f"SELECT id FROM y{n}" for n in range(1, mixing.PASSES + 1))
    return f"""WITH base AS (SELECT doc_id, source, coalesce(source, chr(1)) AS k, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size, md5(concat_ws('|', coalesce(doc_id::VARCHAR, '-'), coalesce(text, '-'))) AS id FROM documents),
sz AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM base GROUP BY k),
rk AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {mixing.MOST_COPIES} AS cap FROM sz),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM rk),
goal AS (SELECT k, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap::DOUBLE, coalesce((SELECT level FROM lv WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1), 0) * weight) END AS target FROM lv),
due AS (SELECT *, odds / (1 + odds) AS v FROM (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM (SELECT *, due - whole AS part FROM (SELECT *, floor(due)::BIGINT AS whole FROM (SELECT base.*, source_size, target, CASE WHEN source_size > 0 THEN least({mixing.MOST_COPIES}::DOUBLE, target / source_size) ELSE 0 END AS due,
  (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS u FROM base JOIN goal USING (k)))))),
room AS (SELECT k, floor(any_value(target))::BIGINT - sum(whole * size)::BIGINT AS room FROM due GROUP BY k), {", ".join(steps)}
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN id IN ({taken}) THEN 1 ELSE 0 END) * size)::BIGINT AS taken, source FROM due"""


def neardup_sql(percent: int = 85) -> str:
    az = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(az)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
r(id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.node), m AS (SELECT id, min(node) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


ORACLE = {"op2_licenses": licenses_sql(), "op4_mixing": mixing_sql(), "op6_quality": quality_sql(), "op8_neardup": neardup_sql(), "op11_merkle": merkle.merkle_sql()}
