"""The queries of plans/queries.py in SQL, as an independent statement of what they return."""

from __future__ import annotations

from sievemark.plans.record_oracle import RECORD_SQL
from sievemark import policy

NULL_LIKE = "('', 'null', 'none', 'na', 'n/a', 'nan', '-', '--', '[]', '{}', 'unknown', '\"\"', '''''')"
TRUSTED, GAP, INSUFFICIENT, REVIEW = "Trusted ICU Coverage", "Likely Medical Gap", "Insufficient Data", "Needs Human Review"
DESERT, FOUND, VERIFY, PLANNING = "Insufficient data to assess", "Trusted ICU evidence found", "Needs facility verification", "Potential planning gap"


def _profile(table: str, columns: list[str]) -> str:
    one = (
        "SELECT '{t}' AS table_name, '{c}' AS column_name, m AS missing, p AS placeholder, n - m - p AS populated, round(100.0 * (m + p) / n, 2)::DOUBLE AS pct_null_like FROM ("
        "SELECT count(*) AS n, count(*) FILTER ({c} IS NULL) AS m, count(*) FILTER (lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) IN {nulls}) AS p FROM {t})"
    )
    return " UNION ALL ".join(one.format(t=table, c=c, nulls=NULL_LIKE) for c in columns)


SHAPES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}

SCORED = f"""
base AS (
  SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, regexp_matches(coalesce(d.text, ''), '(?i)licen[sc]e') AS licence, contains(coalesce(d.text, ''), '@') AS mail,
         regexp_matches(coalesce(d.text, ''), '[0-9]{{3}}') AS number, contains(coalesce(d.text, ''), chr(10)) AS lines, length(coalesce(d.text, '')) AS len,
         coalesce(l.quality = 1, false) AS explicit, coalesce(l.toxic = 1, false) AS toxic_flag
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
points AS (
  SELECT *, len >= 1000 AS long,
    (CASE WHEN explicit THEN 35 ELSE 0 END + CASE WHEN len >= 1000 THEN 20 ELSE 0 END + CASE WHEN number THEN 15 ELSE 0 END + CASE WHEN mail THEN 10 ELSE 0 END
     - CASE WHEN toxic_flag THEN 40 ELSE 0 END - CASE WHEN licence THEN 15 ELSE 0 END) AS e0,
    (CASE WHEN len >= 300 THEN 20 ELSE 0 END + CASE WHEN lines THEN 15 ELSE 0 END + CASE WHEN quality IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN lang = 'en' THEN 10 ELSE 0 END
     + CASE WHEN len < 20000 THEN 10 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 15 ELSE 0 END) AS c0,
    (explicit::INT + (len >= 1000)::INT + number::INT + mail::INT + toxic_flag::INT + licence::INT) AS n_e,
    ((len >= 300)::INT + lines::INT + (quality IS NOT NULL)::INT + coalesce(lang = 'en', false)::INT + (len < 20000)::INT + (source IS NOT NULL)::INT + (lang IS NOT NULL)::INT) AS n_c,
    ((len >= 1000)::INT + mail::INT + number::INT) AS k, coalesce(lang = 'en', false) AND len >= 2000 AS described
  FROM base),
scored AS (
  SELECT *, CASE WHEN toxic_flag THEN '{REVIEW}' WHEN c < 45 THEN '{INSUFFICIENT}' WHEN e >= 45 AND licence THEN '{REVIEW}' WHEN e >= 45 AND NOT explicit THEN '{REVIEW}'
      WHEN e >= 45 AND k >= 2 THEN '{TRUSTED}' WHEN e >= 45 AND described AND k >= 1 THEN '{TRUSTED}' WHEN e >= 45 THEN '{REVIEW}' WHEN e <= 15 THEN '{GAP}' ELSE '{REVIEW}' END AS class
  FROM (SELECT *, greatest(0, least(100, e0)) AS e, greatest(0, least(100, c0)) AS c FROM points))"""

PLACES = SCORED + """,
placed AS (SELECT *, CASE WHEN doc_id % 97 <> 0 THEN lang END AS st, CASE WHEN doc_id % 89 <> 0 THEN source END AS di FROM scored),
named AS (SELECT *, coalesce(st, '(unassigned)') AS state, coalesce(di, '(unassigned)') AS district FROM placed)"""

MEASURES = f"""count(*) AS facility_count, count(*) FILTER (class = '{TRUSTED}') AS trusted_icu_count, count(*) FILTER (class = '{GAP}') AS likely_gap_count,
  count(*) FILTER (class = '{INSUFFICIENT}') AS insufficient_data_count, count(*) FILTER (class = '{REVIEW}') AS needs_review_count,
  coalesce(100.0 * count(*) FILTER (c >= 45) / nullif(count(*), 0), 0) AS pct, coalesce(sum(e * c) / nullif(sum(c), 0) / 100.0, 0) AS w"""
STATUS = f"""CASE WHEN facility_count < 3 OR pct < 40 THEN '{DESERT}' WHEN trusted_icu_count >= 1 THEN '{FOUND}' WHEN needs_review_count > 0 THEN '{VERIFY}' ELSE '{PLANNING}' END"""
COUNTS = "facility_count, trusted_icu_count, likely_gap_count, insufficient_data_count, needs_review_count"
DISTRICTS = PLACES + f""",
district_rows AS (SELECT *, {STATUS} AS region_status FROM (SELECT state, district, {MEASURES} FROM named GROUP BY state, district))"""
LEVELS = PLACES + f""",
levels AS (
  SELECT *, {STATUS} AS region_status, round(pct, 1)::DOUBLE AS pct_sufficient_data FROM (
    SELECT 'state' AS level, state, NULL AS district, {MEASURES} FROM named GROUP BY state
    UNION ALL SELECT 'district', state, district, {MEASURES} FROM named GROUP BY state, district))"""


def _slice(name: str, where: str) -> str:
    return f"SELECT '{name}' AS slice, {COUNTS}, round(w, 3)::DOUBLE AS trust_weighted_icu_coverage, {STATUS} AS region_status FROM (SELECT {MEASURES} FROM placed WHERE {where})"


def _title(c: str) -> str:
    return f"array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)')], '')"


GROUPS = (("explicit_icu", ("licen[sc]e", "copyright")), ("equipment", ("[0-9]{3}-[0-9]{4}",)), ("procedure", ("https?://", "version")), ("staffing", ("[a-z]+@[a-z]+",)), ("specialty_context", ("public",)))
DENIAL = "all\\s+rights\\s+reserved"


def _window(c: str, pattern: str) -> str:
    """The sentence around the first match, at most 300 characters."""
    around = f"'(?i)([^.;\\n]*?)(?:{pattern})[^.;\\n]*'"
    whole = f"regexp_replace(regexp_extract({c}, {around}, 0), '^\\s+|\\s+$', '', 'g')"
    cut = f"regexp_replace(substring({whole}, greatest(length(regexp_extract({c}, {around}, 1)) - 150, 0) + 1, 300), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN length({whole}) > 300 THEN {cut} ELSE {whole} END"


def _fragments() -> str:
    rows, n = [], 0
    for group, patterns in (("negation", (DENIAL,)), *GROUPS):
        for p in patterns:
            denied = f"regexp_matches(text, '(?i){DENIAL}')"
            cond = denied if group == "negation" else f"NOT {denied} AND regexp_matches(text, '(?i){p}')"
            rows.append(f"SELECT doc_id, lang, {n} AS ord, '{group}' AS signal, '{p}' AS pattern, {_window('text', p)} AS fragment FROM documents WHERE text IS NOT NULL AND {cond}")
            n += 1
    return "frag AS (" + " UNION ALL ".join(rows) + ")"


PREDICTED = f"""
pred AS (
  SELECT d.doc_id, d.lang, length(coalesce(d.text, '')) AS len, CASE WHEN l.quality IS NOT NULL THEN CASE WHEN l.quality = 1 THEN '{TRUSTED}' ELSE '{GAP}' END END AS human,
         CASE WHEN length(coalesce(d.text, '')) >= 800 THEN '{TRUSTED}' ELSE '{GAP}' END AS rule_a,
         CASE WHEN d.doc_id % 4 <> 0 THEN CASE WHEN NOT regexp_matches(coalesce(d.text, ''), '[0-9]{{3}}') THEN '{TRUSTED}' ELSE '{GAP}' END END AS rule_b
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

NAMES = "concat_ws(' ', CASE WHEN p_partkey % 5 = 0 THEN 'Dr.' WHEN p_partkey % 5 = 1 THEN 'City hospital' WHEN p_partkey % 5 = 2 THEN 'Lab' WHEN p_partkey % 7 = 3 THEN 'Dental hospital' END, p_name)"

SENTENCES = (
    "A 20 bed ICU, with ventilators and BiPAP", "Critical care team and central oxygen", "There is no intensive care here", "The NICU and PICU have a multipara monitor", "Lacks an ICU", "criticalcare, resuscitation; intubation", "Anaesthesiologist for the critical",
    "mechanical   ventilation with CPAP, infusion pump", "a clinic", "CRITICAL\tCARE nurse, icu staff and an intensivist", "syringe pump; ECMO; defibrillator; oxygen pipeline",
)


def _bounded(pattern: str) -> str:
    """A pattern whose word borders are those of all letters, for a dialect that knows ASCII only."""
    p = pattern.replace("'", "''")
    p = ("(?:^|[^\\pL\\pN_])" + p[2:]) if p.startswith("\\b") else p
    p = (p[:-2] + "(?:$|[^\\pL\\pN_])") if p.endswith("\\b") else p
    return f"(?i){p}"


def _default_scan() -> str:
    kw = policy.Policy().keywords
    hit = lambda g, p: f"SELECT lang, '{g}' AS signal, '{p}' AS pattern FROM d WHERE {'denied' if g == 'negation' else 'NOT denied'} AND regexp_matches(t, '{_bounded(p)}')"
    denied = " OR ".join(f"regexp_matches(t, '{_bounded(p)}')" for p in kw.negation)
    parts = " UNION ALL ".join(hit(g, p) for g in (*policy.GROUPS, "negation") for p in kw.group(g))
    said = ", ".join(f"'{x}'" for x in SENTENCES)
    return f"WITH d AS (SELECT lang, t, {denied} AS denied FROM (SELECT lang, concat_ws(chr(10), text, [{said}][coalesce(n_chars, 0) % {len(SENTENCES)} + 1]) AS t FROM documents)) SELECT lang, signal, pattern, count(*) AS n FROM ({parts}) GROUP BY ALL"


ORACLE_SQL = {
    **RECORD_SQL,
    "q_null_profile": " UNION ALL ".join((_profile("documents", ["text", "lang", "source"]), _profile("pages", ["url", "html"]), _profile("events", ["event_type", "props"]))),
    "q_shape_check": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, {n}::BIGINT AS expected_columns, (SELECT count(*) FROM (DESCRIBE {t})) = {n} AS as_expected" for t, n in SHAPES.items()
    ),
    "q_duplicate_keys": "SELECT sha256(lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) AS text_key, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q_value_counts": "SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "q_top_counts": "SELECT left(p_brand, 7) AS p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "q_dedupe_most_complete": """
SELECT doc_id, lang, quality, n_populated FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_populated DESC, doc_id) AS r FROM (
    SELECT d.*, l.quality, ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT)::BIGINT AS n_populated
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)) WHERE r = 1""",
    "q_top_text_per_source": "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3",
    "q_number_from_text": """
SELECT event_type, sum(k)::BIGINT AS sum_k, count(*) FILTER (k IS NULL) AS without_k, round(sum(value), 2)::DOUBLE AS sum_v
FROM (SELECT event_type, value, try_cast(nullif(regexp_extract(props, '-?[0-9]+', 0), '') AS BIGINT) AS k FROM events) GROUP BY 1""",
    "q_json_list": """
WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT item, count(*) AS n FROM (
  SELECT k AS item FROM e WHERE event_id % 3 = 0 UNION ALL SELECT event_type FROM e WHERE event_id % 3 = 0
  UNION ALL SELECT '["' || k FROM e WHERE event_id % 3 = 1) GROUP BY 1""",
    "q_title_case": f"SELECT {_title('c_mktsegment')} AS name FROM customer UNION SELECT {_title("p_name || '-' || lower(p_type)")} FROM part",
    "q_lookup_fallback": """
WITH j AS (
  SELECT CASE WHEN o_custkey % 7 <> 0 THEN n_name END AS p, CASE WHEN o_orderkey % 3 <> 0 THEN r_name END AS f
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey)
SELECT coalesce(p, f) AS place, CASE WHEN p IS NOT NULL THEN 'lookup' WHEN f IS NOT NULL THEN 'field' ELSE 'none' END AS place_source, coalesce(p <> f, false) AS conflict, count(*) AS n FROM j GROUP BY 1, 2, 3""",
    "q_keyword_scan": f"WITH {_fragments()} SELECT lang, signal, pattern, count(*) AS n FROM frag GROUP BY 1, 2, 3",
    "q_negated_items": f"""
SELECT lang, count(*) FILTER (d) AS denied, count(*) FILTER (c) AS claimed, count(*) FILTER (d AND c) AS suppressed
FROM (SELECT lang, regexp_matches(coalesce(text, ''), '(?i){DENIAL}') AS d, regexp_matches(coalesce(text, ''), '(?i)licen[sc]e|copyright') AS c FROM documents) GROUP BY 1""",
    "q_sentence_window": f"SELECT doc_id, sentence, length(sentence)::BIGINT AS length FROM (SELECT doc_id, {_window('text', 'licen[sc]e')} AS sentence FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e'))",
    "q_fragment_dedup": f"WITH {_fragments()} SELECT doc_id, signal, pattern, fragment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, signal, fragment ORDER BY ord) AS r FROM frag) WHERE r = 1",
    "q_anchored_number": """
SELECT doc_id, max(x::BIGINT) AS largest FROM (
  SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?i)version\\s+(\\d{1,4})', 1), regexp_extract_all(text, '(\\d{1,4})\\.\\d', 1))) AS x FROM documents WHERE text IS NOT NULL) GROUP BY 1""",
    "q_score_components": f"WITH {SCORED} SELECT doc_id, e::BIGINT AS evidence, c::BIGINT AS completeness, n_e::BIGINT AS n_evidence, n_c::BIGINT AS n_completeness FROM scored",
    "q_classify": f"""
WITH {SCORED}
SELECT class AS classification, CASE WHEN toxic_flag THEN 'The record both claims and denies the capability.' WHEN c < 45 THEN 'With completeness ' || c || ' (judgeable from 45) nothing can be concluded, not even absence.'
  WHEN e >= 45 AND licence THEN 'Strong evidence, but a claim in it looks doubtful: check first.' WHEN e >= 45 AND NOT explicit THEN 'Strong signs around the capability, yet it is nowhere claimed: ask on site.'
  WHEN e >= 45 AND k >= 2 THEN 'Evidence ' || e || ' (trusted from 45), judgeable data, and ' || k || ' kinds of evidence in the record.'
  WHEN e >= 45 AND described AND k >= 1 THEN 'Evidence ' || e || ' (trusted from 45); policy v2 takes the description''s own statement with ' || k || ' categor' || CASE WHEN k = 1 THEN 'y' ELSE 'ies' END || ' of operation as corroboration.'
  WHEN e >= 45 THEN 'Strong, but only ' || k || ' categor' || CASE WHEN k = 1 THEN 'y' ELSE 'ies' END || ' of evidence stand beside the claim (2 are needed, or one and a statement in the description): no phrase may back itself.'
  WHEN e <= 15 THEN 'Full enough to judge (completeness ' || c || '), and no credible evidence in it; whether that is a gap is asked for the region.' ELSE 'Evidence ' || e || ' lies between 15 and 45: someone should read the fragments.' END AS reason, count(*) AS n
FROM scored GROUP BY 1, 2""",
    "q_policy_whatif": f"""
WITH {SCORED}
SELECT class AS classification, CASE WHEN toxic_flag THEN '{REVIEW}' WHEN c < 45 THEN '{INSUFFICIENT}' WHEN e >= 55 AND licence THEN '{REVIEW}' WHEN e >= 55 AND NOT explicit THEN '{REVIEW}'
  WHEN e >= 55 AND k >= 2 THEN '{TRUSTED}' WHEN e >= 55 THEN '{REVIEW}' WHEN e <= 20 THEN '{GAP}' ELSE '{REVIEW}' END AS other_classification, count(*) AS n
FROM scored GROUP BY 1, 2""",
    "q_region_rollup": f"WITH {LEVELS} SELECT level, state, district, {COUNTS}, pct_sufficient_data, round(100.0 * trusted_icu_count / facility_count, 1)::DOUBLE AS evidence_coverage_pct, round(w, 3)::DOUBLE AS trust_weighted_icu_coverage, region_status FROM levels",
    "q_region_metrics_tpch": f"""
WITH a AS (
  SELECT r_name, n_name, count(*) AS facility_count, count(*) FILTER (c_acctbal >= 9500) AS trusted_icu_count, count(*) FILTER (c_acctbal < 0) AS needs_review_count,
         100.0 * avg((c_acctbal >= 5000)::INT) AS pct, sum(c_acctbal * length(c_mktsegment)) / sum(length(c_mktsegment)) AS w
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name, n_name, facility_count AS n, round(pct, 4)::DOUBLE AS share, round(w, 2)::DOUBLE AS weighted_balance, {STATUS} AS region_status FROM a""",
    "q_decision_path": f"""
WITH {LEVELS}, g AS (SELECT *, facility_count >= 3 AS a, pct_sufficient_data >= 40 AS b FROM levels), s AS (
  SELECT level, state, district, 1 AS o, 'Enough records?' AS question, a AS passed FROM g
  UNION ALL SELECT level, state, district, 2, 'Enough judgeable data?', b FROM g WHERE a
  UNION ALL SELECT level, state, district, 3, 'Trusted ICU evidence found?', trusted_icu_count >= 1 FROM g WHERE a AND b
  UNION ALL SELECT level, state, district, 4, 'Unresolved ICU claims?', needs_review_count = 0 FROM g WHERE a AND b
  UNION ALL SELECT level, state, district, 5, 'Regional result', NULL FROM g)
SELECT level, state, district, (row_number() OVER (PARTITION BY level, state, district ORDER BY o) - 1)::BIGINT AS step, question, passed FROM s""",
    "q_status_distribution": f"""
WITH {SCORED}, c AS (SELECT * FROM (VALUES (0, '{TRUSTED}'), (1, '{GAP}'), (2, '{INSUFFICIENT}'), (3, '{REVIEW}')) AS v(position, classification)),
t AS (SELECT lang, count(*) AS total FROM scored GROUP BY 1), n AS (SELECT lang, class, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT t.lang, c.position::BIGINT AS position, c.classification, coalesce(n.n, 0)::BIGINT AS n, round(100.0 * coalesce(n.n, 0) / total, 4)::DOUBLE AS pct
FROM t CROSS JOIN c LEFT JOIN n ON n.lang IS NOT DISTINCT FROM t.lang AND n.class = c.classification""",
    "q_class_region_pivot": f"""
WITH {SCORED}
SELECT source, count(*) AS total, count(*) FILTER (class = '{TRUSTED}') AS n_0, count(*) FILTER (class = '{GAP}') AS n_1, count(*) FILTER (class = '{INSUFFICIENT}') AS n_2, count(*) FILTER (class = '{REVIEW}') AS n_3
FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
    "q_order_pivot": """
SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p,
       count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY total DESC, 1 LIMIT 30""",
    "q_centroid": """
SELECT n_name, round(median(c_acctbal) FILTER (c_acctbal >= 0), 3)::DOUBLE AS median_balance, round(median(c_custkey) FILTER (c_acctbal >= 0), 3)::DOUBLE AS median_key,
       count(*) FILTER (c_acctbal >= 0) AS n_located, count(*) AS n_all
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) FILTER (c_acctbal >= 0) > 0""",
    "q_extent": """
SELECT l_returnflag, round((min(l_quantity) + max(l_quantity)) / 2, 4)::DOUBLE AS mid_a, round((min(l_discount * 100) + max(l_discount * 100)) / 2, 4)::DOUBLE AS mid_b,
       round(least(greatest(log2(360 / greatest(max(l_quantity) - min(l_quantity), max(l_discount * 100) - min(l_discount * 100), 0.01)) - 1.5, 6), 13), 4)::DOUBLE AS zoom
FROM lineitem GROUP BY 1""",
    "q_facility_mix": """
SELECT *, n_outpatient > 0 AND (n_general = 0 OR n_outpatient >= n_general) AS mix_warning FROM (
  SELECT p_brand, count(*) FILTER (p_type = 'LARGE') AS n_general, count(*) FILTER (p_type = 'PROMO') AS n_specialty, count(*) FILTER (p_type IN ('SMALL', 'MEDIUM')) AS n_outpatient,
         count(*) FILTER (p_type NOT IN ('LARGE', 'PROMO', 'SMALL', 'MEDIUM')) AS n_unknown FROM part GROUP BY 1)""",
    "q_attention_topk": f"""
WITH {DISTRICTS}
SELECT region_status, state, district, facility_count, rank, greatest(total - 5, 0)::BIGINT AS n_more FROM (
  SELECT *, row_number() OVER (PARTITION BY region_status ORDER BY facility_count DESC, state, district) AS rank, count(*) OVER (PARTITION BY region_status) AS total
  FROM district_rows WHERE state <> '(unassigned)' AND district <> '(unassigned)') WHERE rank <= 5""",
    "q_example_regions": f"""
WITH {DISTRICTS}
SELECT region_status, state, district, facility_count FROM (
  SELECT *, row_number() OVER (PARTITION BY region_status ORDER BY facility_count DESC, state, district) AS r
  FROM district_rows WHERE state <> '(unassigned)' AND district <> '(unassigned)' AND facility_count > 0) WHERE r = 1 AND region_status <> '{FOUND}'""",
    "q_region_slice": "WITH " + PLACES + " " + " UNION ALL ".join(
        (_slice("all/all", "true"), _slice("en/all", "st = 'en'"), _slice("(unassigned)/all", "st IS NULL"), _slice("fr/(unassigned)", "st = 'fr' AND di IS NULL"), _slice("de/src3", "st = 'de' AND di = 'src3'"))
    ),
    "q_spread_stats": "SELECT l_returnflag, count(l_extendedprice) AS n, round(median(l_extendedprice), 3)::DOUBLE AS median, "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 3)::DOUBLE AS p{q}" for q in (5, 25, 50, 75, 95))
    + ", "
    + ", ".join(f"count(*) FILTER (least(floor(l_extendedprice / 10000), 9) = {i}) AS bin_{i}" for i in range(10))
    + " FROM lineitem GROUP BY 1",
    "q_score_stats": "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 4)::DOUBLE AS mean, round(median(l_quantity), 4)::DOUBLE AS median, "
    + ", ".join(f"round(quantile_cont(l_quantity, {q / 100}), 4)::DOUBLE AS p{q}" for q in (5, 25, 50, 75, 95))
    + ", "
    + ", ".join(f"count(*) FILTER (least(floor(l_quantity / 5), 9) = {i}) AS bin_{i}" for i in range(10))
    + " FROM lineitem GROUP BY 1",
    "q_combo_counts": f"""
WITH {SCORED}, c AS (
  SELECT lang, array_to_string([x FOR x IN [CASE WHEN len < 20000 THEN 'capacity' END, CASE WHEN len >= 300 THEN 'description' END, CASE WHEN quality IS NOT NULL THEN 'equipment' END, CASE WHEN lang IS NOT NULL THEN 'geography' END,
    CASE WHEN lines THEN 'procedure' END, CASE WHEN source IS NOT NULL THEN 'source_url' END, CASE WHEN lang = 'en' THEN 'staffing' END] IF x IS NOT NULL], '+') AS combination FROM scored)
SELECT lang, combination, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 4)::DOUBLE AS pct FROM c GROUP BY 1, 2""",
    "q_dominance": "SELECT s_nationkey, count(*) AS n, round(avg((s_acctbal < 5000)::INT), 4)::DOUBLE AS share FROM supplier GROUP BY 1 HAVING avg((s_acctbal < 5000)::INT) >= 0.5 ORDER BY avg((s_acctbal < 5000)::INT) DESC, 2 DESC, 1 LIMIT 20",
    "q_confusion": "SELECT quality AS human, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2",
    "q_per_class_metrics": f"""
WITH {PREDICTED}, k AS (SELECT * FROM pred WHERE human IS NOT NULL), c AS (SELECT human AS label FROM k UNION SELECT rule_a FROM k)
SELECT label, round(count(*) FILTER (human = label AND rule_a = label) / nullif(count(*) FILTER (rule_a = label), 0), 3)::DOUBLE AS precision,
       round(count(*) FILTER (human = label AND rule_a = label) / nullif(count(*) FILTER (human = label), 0), 3)::DOUBLE AS recall, count(*) FILTER (human = label) AS support
FROM c CROSS JOIN k GROUP BY 1""",
    "q_agreement": f"""
WITH {PREDICTED}, x AS (SELECT 'a' AS extractor, lang, human, rule_a AS p FROM pred WHERE human IS NOT NULL UNION ALL SELECT 'b', lang, human, rule_b FROM pred WHERE human IS NOT NULL AND rule_b IS NOT NULL)
SELECT extractor, lang, count(*) AS n_rows, round(100.0 * avg((p = human)::INT), 1)::DOUBLE AS agreement_pct, count(*) FILTER (p = '{TRUSTED}' AND human <> '{TRUSTED}') AS false_trusted, count(*) FILTER (p = '{GAP}' AND human <> '{GAP}') AS false_gap
FROM x GROUP BY 1, 2""",
    "q_extractor_compare": f"""
WITH {PREDICTED} SELECT count(*) AS n_rows, count(human) AS pairs, round(100.0 * avg((rule_a = human)::INT), 1)::DOUBLE AS agreement_pct, round(avg(abs(length(rule_a) - length(human))), 2)::DOUBLE AS mean_difference,
  sum(length(rule_a))::BIGINT AS verified, sum(len)::BIGINT AS dropped, count(rule_b) AS second FROM pred""",
    "q_progress": f"WITH {PREDICTED} SELECT count(*) AS rows_total, count(human) AS rows_labelled, count(*) - count(human) AS rows_pending FROM pred",
    "q_disagreements": f"WITH {PREDICTED} SELECT doc_id, human, rule_a FROM pred WHERE human <> rule_a",
    "q_semi_anti": """
SELECT 'labelled' AS part, lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 2
UNION ALL SELECT 'unlabelled', lang, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2""",
    "q_stratified_sample": """
WITH d AS (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (
  SELECT doc_id, 0 AS part FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM d WHERE quality IS NOT NULL) WHERE r <= 10
  UNION ALL SELECT doc_id, 1 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM d WHERE lang IS NOT NULL) WHERE r <= 8
  UNION ALL SELECT doc_id, 2 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM d WHERE source IS NOT NULL) WHERE r <= 2)
SELECT d.doc_id, d.lang, d.source, q.part::BIGINT AS part FROM (SELECT doc_id, min(part) AS part FROM p GROUP BY 1) q JOIN d ON d.doc_id = q.doc_id ORDER BY d.doc_id LIMIT 65""",
    "q_merge_preserving": """
SELECT doc_id, 'labelled' AS lang, 'kept' AS note FROM labels
UNION ALL SELECT doc_id, lang, '' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "q_batches": "SELECT b AS batch_id, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 25)::BIGINT AS b FROM documents) GROUP BY 1",
    "q_disagreeing_ids": """
SELECT d.doc_id, CASE WHEN length(d.text) >= 800 THEN '1' ELSE '0' END AS left_value, l.quality::VARCHAR AS right_value
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE (length(d.text) >= 800) IS DISTINCT FROM (l.quality = 1)""",
    "q_id_accounting": """
WITH a AS (SELECT o_orderkey AS id, (o_orderkey // 1000)::BIGINT AS b, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT l_orderkey AS id, (l_orderkey // 1000)::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.b, g.b) AS batch_id, CASE WHEN a.n IS NULL THEN 'unknown' WHEN g.n IS NULL THEN 'missing' WHEN g.n > 1 THEN 'duplicate' ELSE 'none' END AS problem, count(*) AS n
FROM a FULL JOIN g ON a.id = g.id AND a.b = g.b GROUP BY 1, 2""",
    "q_quote_verify": """
WITH q AS (SELECT item_id, array_to_string(regexp_extract_all(text, '[^ \\t-\\r]+'), ' ') AS quote FROM benchmark WHERE len(regexp_extract_all(text, '[^ \\t-\\r]+')) > 0),
d AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\t-\\r]+'), ' ') AS words FROM documents WHERE text IS NOT NULL)
SELECT item_id, doc_id, quote FROM q JOIN d ON contains(words, quote)""",
    "q_default_scan": _default_scan(),
    "q_turn_checks": """
SELECT CASE WHEN n > u THEN 'duplicate' WHEN l <> 0 OR m + 1 <> u THEN 'missing' ELSE 'complete' END AS state, n AS turns, count(*) AS n_conversations
FROM (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS u, max(turn) AS m, min(turn) AS l FROM conversations GROUP BY 1) GROUP BY 1, 2""",
    "q_id_quarantine": """
WITH e AS (SELECT event_type || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '-' END || event_id AS unique_id FROM events), v AS (SELECT *, regexp_full_match(unique_id, '[A-Za-z0-9][A-Za-z0-9_-]{5,63}') AS ok FROM e)
SELECT count(*) AS n, min(unique_id) AS first_id, max(unique_id) AS last_id, 'good' AS part FROM v WHERE ok UNION ALL SELECT count(*), min(unique_id), max(unique_id), 'quarantined' FROM v WHERE NOT ok""",
    "q_payload_check": """
SELECT event_id % 5 = 0 AS valid, CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'malformed JSON' WHEN 2 THEN 'unknown keys' WHEN 3 THEN 'required value missing or of a wrong type' ELSE 'empty response' END AS reason, count(*) AS n
FROM events GROUP BY 1, 2""",
    "q_resume": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "q_spend": """
SELECT n AS records, round(c, 6)::DOUBLE AS cost_usd, c > 0.01 AS over_limit
FROM (SELECT count(*) AS n, sum(length(text) * CASE WHEN role = 'assistant' THEN 0.60::DOUBLE ELSE 0.15::DOUBLE END) / 1e6 AS c FROM conversations)""",
    "q_display_order": f"""
WITH {_fragments()}, r AS (
  SELECT signal, row_number() OVER (PARTITION BY doc_id ORDER BY CASE signal WHEN 'negation' THEN 0 WHEN 'explicit_icu' THEN 1 WHEN 'equipment' THEN 2 WHEN 'procedure' THEN 3 WHEN 'staffing' THEN 4 ELSE 5 END, ord) - 1 AS rank FROM frag)
SELECT rank::BIGINT AS rank, signal, count(*) AS n FROM r WHERE rank < 5 GROUP BY 1, 2""",
    "q_incremental_regions": """
WITH e AS (
  SELECT event_type AS state, CASE WHEN user_id % 10 > 0 THEN 'u' || (user_id % 40) ELSE '(unassigned)' END AS district, event_id % 9 AS k, event_id % 101 AS c, least(100, greatest(0, floor(value))) AS s FROM events),
r AS (
  SELECT state, district, count(*) AS facility_count, count(*) FILTER (k = 0) AS trusted_icu_count, count(*) FILTER (k BETWEEN 3 AND 6) AS likely_gap_count, count(*) FILTER (k > 6) AS insufficient_data_count,
    count(*) FILTER (k IN (1, 2)) AS needs_review_count, 100.0::DOUBLE * count(*) FILTER (c >= 45) / count(*) AS p, sum(s * c)::DOUBLE / nullif(sum(c), 0)::DOUBLE / 100.0::DOUBLE AS w FROM e GROUP BY 1, 2)
SELECT state, district, facility_count, trusted_icu_count, likely_gap_count, insufficient_data_count, needs_review_count, round(p, 1) AS pct_sufficient_data, round(100.0::DOUBLE * trusted_icu_count / facility_count, 1) AS evidence_coverage_pct,
  round(coalesce(w, 0), 3) AS trust_weighted_icu_coverage, CASE WHEN facility_count < 3 OR p < 40 THEN 'Insufficient data to assess' WHEN trusted_icu_count >= 1 THEN 'Trusted ICU evidence found' WHEN needs_review_count > 0 THEN 'Needs facility verification' ELSE 'Potential planning gap' END AS region_status
FROM r""",
    "q_snapshot_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    "q_notes_scoped": "SELECT event_id AS id, event_type AS scope_type, props AS note FROM events WHERE event_type = 'purchase' AND user_id = 7",
    "q_note_checks": """
WITH n AS (SELECT CASE WHEN event_type = 'error' THEN 'planet' WHEN event_id % 2 = 0 THEN 'state' ELSE 'district' END AS scope_type, event_id % 7 = 0 AS blank FROM events)
SELECT CASE WHEN scope_type = 'planet' THEN 'unknown scope type' WHEN blank THEN 'blank note' ELSE 'accepted' END AS outcome, scope_type, count(*) AS n FROM n GROUP BY 1, 2""",
    "q_fingerprint": """
WITH c AS (SELECT coalesce(o_orderstatus, '') AS k, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n_rows, left(sha256(string_agg(k || '=' || n, ';' ORDER BY k)), 12) AS digest FROM c)
SELECT n_rows, digest, n_rows || '-' || digest AS data_snapshot_id FROM t""",
    "q_round_trips": """
SELECT sink, count(*) FILTER (k = 0 OR (k = 1 AND c_custkey % 10 > 0) OR (k = 2 AND c_custkey % 10 = 0)) AS n, CASE WHEN k = 2 THEN 'skipped' ELSE 'same' END AS drift
FROM customer, (VALUES ('parquet', 0), ('labels', 0), ('json lines', 0), ('torn lines', 1), ('torn lines, by schema', 1), ('torn', 2)) v(sink, k) GROUP BY sink, k""",
    "q_drift": """
WITH c AS (SELECT id, coalesce(v, '') AS k, count(*) AS n FROM (SELECT 'o_orderstatus' AS id, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY ALL),
t AS (SELECT id, sum(n)::BIGINT || '-' || left(sha256(string_agg(k || '=' || n, ';' ORDER BY k)), 12) AS data_snapshot_id FROM c GROUP BY id)
SELECT id, data_snapshot_id, data_snapshot_id <> (SELECT data_snapshot_id FROM t WHERE id = 'o_orderstatus') AS stale FROM t""",
    "q_drift_ranges": """
WITH a AS (SELECT (o_orderkey // 500)::BIGINT AS r, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY 1),
b AS (SELECT (k // 500)::BIGINT AS r, count(*) AS n, list(k ORDER BY k) AS l FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) GROUP BY 1)
SELECT coalesce(a.r, b.r) AS key_range, coalesce(a.n, 0) AS n_saved, coalesce(b.n, 0) AS n_now, CASE WHEN a.r IS NULL THEN 'added' WHEN b.r IS NULL THEN 'removed' WHEN a.l = b.l THEN 'same' ELSE 'changed' END AS drift FROM a FULL JOIN b ON a.r = b.r""",
    "q_run_compatibility": """
SELECT field, recorded, current, count(*) AS n FROM (
  SELECT unnest([{'field': 'o_orderpriority', 'recorded': o_orderpriority, 'current': '1-URGENT'}, {'field': 'o_orderstatus', 'recorded': o_orderstatus, 'current': 'O'}, {'field': 'year', 'recorded': year(o_orderdate)::VARCHAR, 'current': '1995'}], recursive := true)
  FROM orders WHERE o_orderkey % 50 = 7) WHERE recorded IS DISTINCT FROM current GROUP BY ALL""",
    "q_incremental": "SELECT event_type, count(*) AS n, sum(least(100, greatest(0, floor(value))))::BIGINT AS total_score FROM events WHERE event_type <> 'error' GROUP BY 1",
}
