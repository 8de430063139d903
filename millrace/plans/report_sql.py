"""SQL that gives the same rows as extraction, diagnosis and the gate before generation.

Written over the same rule tables as the operators, with joins and windows of its own.
"""

from __future__ import annotations

from millrace.operators.gates import LEAST_CONFIDENCE, RELAXED_CONFIDENCE
from millrace.plans import rules


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(text(v) if v is None or isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def has(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in phrases) + ")"


def first(column: str, table: dict[str, list[str]], default: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {has(column, phrases)} THEN {text(name)}" for name, phrases in table.items()) + f" ELSE {text(default)} END"


def match(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {text(plain(pattern))}, {group}), '')"


def plain(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)")


def features(reports: str) -> str:
    """WITH parts r, f: the features of the relation `reports` (query_id, raw_problem)."""
    symptoms = ", ".join(f"CASE WHEN {has('low', phrases)} THEN {text(name)} END" for name, phrases in rules.SYMPTOMS.items())
    days, roasted, weeks = (f"{match('raw', rules.FRESHNESS, g)}::INT" for g in (1, 2, 3))
    origin = first("low", {o: [o] for o in rules.ORIGINS}, None)
    return f"""r AS (SELECT query_id, raw_problem, coalesce(raw_problem, '') AS raw, lower(coalesce(raw_problem, '')) AS low FROM ({reports})),
f1 AS (SELECT query_id, raw_problem, low, {first("low", rules.MACHINES, "unknown")} AS machine_type, coalesce({", ".join(match("raw", p) for p in rules.MODELS)}) AS machine_model,
  list_filter([{symptoms}], lambda x: x IS NOT NULL) AS symptoms, floor({match("raw", rules.TIME)}::DOUBLE)::INT AS t, {match("raw", rules.DOSE)}::DOUBLE AS dose, {match("raw", rules.TEMPERATURE)}::DOUBLE AS temp,
  {match("low", rules.GRIND, 0)} AS grind_size, {origin} AS origin, {first("low", rules.ROASTS, None)} AS roast_level,
  coalesce({days}, {roasted} * CASE WHEN regexp_matches(raw, {text(rules.ROASTED_WEEKS)}) THEN 7 ELSE 1 END, {weeks} * 7) AS fresh, '1:' || {match("raw", rules.RATIO)} AS water_ratio FROM r),
f2 AS (SELECT *, CASE WHEN regexp_matches(low, {text(rules.ERROR_CODE)}) OR {has("low", rules.PURCHASE)} OR {has("low", rules.SELECTION)} OR {has("low", rules.SCIENCE)} OR ({has("low", rules.RECIPE)} AND len(symptoms) = 0) THEN 'general'
  WHEN {has("low", rules.LEARN)} THEN 'learn' WHEN {has("low", rules.EXPLORE)} THEN 'explore' WHEN {has("low", rules.OPTIMIZE)} THEN 'optimize' ELSE 'troubleshoot' END AS g,
  coalesce(t, 0) <> 0 OR coalesce(dose, 0) <> 0 OR coalesce(temp, 0) <> 0 OR grind_size IS NOT NULL OR water_ratio IS NOT NULL AS specs, upper(substr(origin, 1, 1)) || substr(origin, 2) AS bean_origin FROM f1),
f AS (SELECT *, CASE WHEN len(symptoms) = 0 AND specs AND g NOT IN ('learn', 'explore') THEN 'optimize' ELSE g END AS goal FROM f2)"""


def extract_sql(reports: str) -> str:
    return f"""WITH {features(reports)} SELECT query_id, machine_type, machine_model, array_to_string(symptoms, ',') AS symptoms, t AS extraction_time_seconds, dose AS dose_grams, temp AS water_temp_celsius, grind_size, bean_origin, roast_level,
fresh AS bean_freshness_days, water_ratio, goal, machine_type = 'unknown' OR (len(symptoms) = 0 AND goal = 'troubleshoot') AS needs_fallback FROM f"""


def diagnosis(reports: str) -> str:
    """WITH parts down to d: route, symptoms, causes, plan, confidence and warnings of each report."""
    causes = [(*(k.split("/") + [None])[:2], i, *row) for k, table in rules.CAUSES.items() for i, row in enumerate(table)]
    steps = [(s, i, *row) for s, table in rules.STEPS.items() for i, row in enumerate(table)]
    learn = [(i, *row) for i, row in enumerate(rules.LEARN_STEPS)]
    can = [(m, p) for m, ps in rules.ADJUSTABLE.items() for p in ps]
    need = list(rules.CAPABILITY.items())
    espresso, pumped = "machine_type IN ('super_automatic', 'semi_automatic', 'manual_lever')", "machine_type IN ('super_automatic', 'semi_automatic')"
    tuned = [
        (f"{espresso} AND t < 22", "'grind_size'", "'finer'", "'1 notch'", "'high'", "'Extraction under 22 s: grind one notch finer'"), (f"{espresso} AND t > 35", "'grind_size'", "'coarser'", "'1 notch'", "'high'", "'Extraction over 35 s: grind one notch coarser'"),
        ("machine_type = 'v60' AND (t < 120 OR t > 240)", "'grind_size'", "CASE WHEN t < 120 THEN 'finer' ELSE 'coarser' END", "'0.5 notch'", "'medium'", "'Brew time of ' || t || ' s is outside 2-4 minutes: adjust the grind'"),
        (f"{pumped} AND (dose < 14 OR dose > 22)", "'dose'", "NULL", "NULL", "'medium'", "'Dose of ' || dose || ' g is outside the espresso range: check the basket''s size'"),
        ("roast_level = 'light' AND temp < 92", "'water_temp'", "'higher'", "'2-3°C'", "'medium'", "temp || '°C may be too cool for a light roast: try 93-96°C'"), ("roast_level = 'dark' AND temp > 94", "'water_temp'", "'lower'", "'2-3°C'", "'medium'", "temp || '°C may be too hot for a dark roast: try 88-92°C'"),
        ("fresh > 21", "'freshness'", "NULL", "NULL", "'critical'", "'Beans are ' || fresh || ' days old: best within 7-21 days'"),
    ]
    optimal = " UNION ALL ".join(f"SELECT query_id, machine_type, 0 AS i, {n} AS seq, {p} AS parameter, {d} AS direction, {m} AS magnitude, {pr} AS priority, {a} AS action FROM c WHERE route = 'optimize' AND {when}" for n, (when, p, d, m, pr, a) in enumerate(tuned))
    return f"""{features(reports)},
causes(symptom, method, c_seq, hypothesis, weight, parameter) AS (VALUES {values(causes)}), steps(symptom, s_seq, parameter, direction, magnitude, priority, action) AS (VALUES {values(steps)}),
lessons(seq, parameter, direction, magnitude, priority, action) AS (VALUES {values(learn)}), can(machine, capability) AS (VALUES {values(can)}), need(parameter, capability) AS (VALUES {values(need)}),
c0 AS (SELECT *, CASE WHEN goal = 'general' THEN 'general' WHEN goal IN ('learn', 'explore') AND len(symptoms) = 0 THEN 'learn' WHEN goal = 'optimize' AND len(symptoms) = 0 THEN 'optimize' WHEN len(symptoms) = 0 THEN 'no_symptoms' ELSE 'rules' END AS route FROM f),
c AS (SELECT *, CASE WHEN route <> 'rules' THEN [] WHEN list_contains(symptoms, 'bitter') AND list_contains(symptoms, 'sour') THEN list_concat(['bitter_and_sour'], list_filter(symptoms, lambda x: x NOT IN ('bitter', 'sour', 'bitter_and_sour'))) ELSE symptoms END AS s FROM c0),
a AS (SELECT query_id, machine_type, t, fresh, unnest(s) AS symptom, unnest(range(len(s))) AS s_pos FROM c),
own AS (SELECT DISTINCT symptom, method FROM causes WHERE method IS NOT NULL),
h AS (SELECT a.*, k.c_seq, k.hypothesis, k.weight::DOUBLE AS weight, k.parameter FROM a LEFT JOIN own ON own.symptom = a.symptom AND own.method = a.machine_type JOIN causes k ON k.symptom = a.symptom AND k.method IS NOT DISTINCT FROM own.method),
p AS (SELECT *, min(s_pos * 100 + c_seq) OVER (PARTITION BY query_id, hypothesis) AS place, row_number() OVER (PARTITION BY query_id, hypothesis ORDER BY weight DESC, s_pos, c_seq) AS nth FROM h),
b AS (SELECT *, CASE WHEN coalesce(t, 0) > 0 AND t < 20 AND hypothesis = 'under-extraction' THEN 0.2 WHEN coalesce(t, 0) > 32 AND hypothesis = 'over-extraction' THEN 0.2 WHEN coalesce(fresh, 0) > 30 AND contains(hypothesis, 'stale') THEN 0.2 WHEN machine_type = 'moka' AND hypothesis = 'heat_too_high' THEN 0.15 ELSE 0 END::DOUBLE AS more FROM p WHERE nth = 1),
q AS (SELECT *, CASE WHEN more > 0 THEN least(0.95, round(weight + more, 10)) ELSE weight END::DOUBLE AS probability FROM b),
q1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, weight DESC, place) AS r FROM q),
rc AS (SELECT query_id, string_agg(hypothesis || '=' || printf('%.2f', probability) || '/' || coalesce(parameter, '-'), ',' ORDER BY r) AS causes, max(probability) FILTER (WHERE r = 1) AS top, max(hypothesis) FILTER (WHERE r = 1) AS hypothesis FROM q1 WHERE r <= 3 GROUP BY query_id),
tuned AS ({optimal}),
st AS (SELECT a.query_id, a.machine_type, a.s_pos AS i, s_seq AS seq, parameter, direction, magnitude, priority, action FROM a JOIN steps USING (symptom) UNION ALL SELECT * FROM tuned
  UNION ALL SELECT query_id, machine_type, 0, 0, NULL, NULL, NULL, 'high', 'Share dose, time and temperature for a closer look' FROM c WHERE route = 'optimize' AND query_id NOT IN (SELECT query_id FROM tuned)
  UNION ALL SELECT query_id, machine_type, 0, seq, parameter, direction, magnitude, priority, action FROM c, lessons WHERE route = 'learn'
  UNION ALL SELECT query_id, machine_type, 0, 0, NULL, NULL, NULL, 'medium', 'Answer from general knowledge: this is not a taste problem' FROM c WHERE route = 'general'
  UNION ALL SELECT query_id, machine_type, 0, 0, NULL, NULL, NULL, 'high', 'Say what tastes wrong, or share your parameters' FROM c WHERE route = 'no_symptoms'),
ok AS (SELECT st.*, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS rank, parameter IS NULL OR EXISTS (SELECT 1 FROM can WHERE machine = st.machine_type AND can.capability = coalesce((SELECT n.capability FROM need n WHERE n.parameter = st.parameter), st.parameter)) AS may FROM st),
o1 AS (SELECT *, CASE WHEN parameter IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY query_id, parameter ORDER BY rank, i, seq) END AS n FROM ok WHERE may OR parameter IN ({", ".join(map(text, rules.UNIVERSAL))})),
o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, i, seq) AS step FROM o1 WHERE n = 1),
pl AS (SELECT query_id, string_agg(step || ' ' || coalesce(parameter, '-') || ' ' || coalesce(direction, '-') || ' ' || coalesce(magnitude, '-') || ' ' || priority || ': ' || action, '; ' ORDER BY step) AS plan FROM o2 WHERE step <= 4 GROUP BY query_id),
d AS (SELECT c.*, coalesce(rc.causes, '') AS causes, rc.hypothesis, coalesce(pl.plan, '') AS plan,
  CASE route WHEN 'general' THEN 0.15 WHEN 'learn' THEN 0.5 WHEN 'optimize' THEN 0.55 WHEN 'no_symptoms' THEN 0.1 ELSE CASE WHEN rc.causes IS NULL THEN 0 ELSE printf('%.2f', rc.top * (CASE WHEN coalesce(t, 0) = 0 THEN 0.8 ELSE 1 END::DOUBLE * CASE WHEN machine_type = 'unknown' THEN 0.7 ELSE 1 END::DOUBLE))::DOUBLE END END::DOUBLE AS confidence,
  array_to_string(list_filter(CASE route WHEN 'learn' THEN ['Learning: principles, not a fix.'] WHEN 'optimize' THEN [CASE WHEN coalesce(fresh, 0) > 21 THEN 'Beans are ' || fresh || ' days old.' ELSE 'Optimising: share parameters for a closer look.' END] WHEN 'general' THEN ['General question: answered from general knowledge.'] WHEN 'no_symptoms' THEN ['Describe a symptom or share parameters.']
    ELSE [CASE WHEN coalesce(fresh, 0) > 45 THEN 'Beans are probably stale (over 45 days): try fresh ones first.' END, CASE WHEN machine_type = 'unknown' THEN 'Machine not identified: advice is generic.' END, CASE WHEN machine_type = 'nespresso' THEN 'Extraction is fixed on this machine: choose other capsules and keep it clean.' END] END, lambda x: x IS NOT NULL), ' ') AS warnings
  FROM c LEFT JOIN rc USING (query_id) LEFT JOIN pl USING (query_id))"""


def diagnose_sql(reports: str) -> str:
    query = "concat_ws(' ', replace(machine_type, '_', ' '), replace(s[1], '_', ' '), replace(replace(hypothesis, '_', ' '), '-', ' '), CASE WHEN machine_type <> 'unknown' THEN replace(machine_type, '_', ' ') || ' coffee extraction' END, bean_origin, roast_level || ' roast')"
    return f"WITH {diagnosis(reports)} SELECT query_id, route, array_to_string(s, ',') AS symptoms, causes, plan, confidence AS diagnostic_confidence, warnings, {query} AS retrieval_query FROM d"


def gate_sql(reports: str, found: bool = True) -> str:
    """found: whether what was retrieved is good (or was not asked for)."""
    relaxed = "goal IN ('learn', 'optimize', 'explore', 'general')"
    possible = "NOT EXISTS (SELECT 1 FROM o2 WHERE o2.query_id = d.query_id AND step <= 4 AND parameter IS NOT NULL AND coalesce((SELECT n.capability FROM need n WHERE n.parameter = o2.parameter), o2.parameter) NOT IN ('freshness', 'machine_cleaning') AND NOT EXISTS (SELECT 1 FROM can WHERE machine = d.machine_type AND can.capability = coalesce((SELECT n.capability FROM need n WHERE n.parameter = o2.parameter), o2.parameter)))"
    return f"""WITH {diagnosis(reports)}, k AS (SELECT query_id, {relaxed} OR len(s) >= 1 AS k1, {relaxed} OR causes <> '' AS k2, plan <> '' AS k3, confidence >= CASE WHEN {relaxed} THEN {RELAXED_CONFIDENCE} ELSE {LEAST_CONFIDENCE} END AS k4, machine_type <> 'unknown' AS k5, {possible} AS k6 FROM d),
n AS (SELECT *, (NOT k1)::INT + (NOT k2)::INT + (NOT k3)::INT + (NOT k4)::INT + (NOT k5)::INT + (NOT k6)::INT + {int(not found)} AS lost FROM k)
SELECT query_id, k1 AS symptoms_detected, k2 AS root_causes_present, k3 AS intervention_plan_present, k4 AS confidence_sufficient, k5 AS machine_identified, k6 AS interventions_feasible, round((7 - lost) / 7, 2)::DOUBLE AS overall_score,
CASE WHEN NOT k3 OR NOT k4 THEN 'blocked' WHEN lost = 0 THEN 'ready' WHEN lost <= 2 THEN 'review' ELSE 'blocked' END AS verdict FROM n"""
