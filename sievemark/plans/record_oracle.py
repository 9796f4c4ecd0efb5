"""The queries of plans/record_queries.py in SQL: evidence, scores, flags and classes worked out from
the documents by set operations, beside the engine's own arrays."""

from __future__ import annotations

from sievemark.functions.names import CATEGORY_RULES, DOCTOR

TRUSTED, GAP, INSUFFICIENT, REVIEW = "Trusted ICU Coverage", "Likely Medical Gap", "Insufficient Data", "Needs Human Review"
DESERT, FOUND, VERIFY, PLANNING = "Insufficient data to assess", "Trusted ICU evidence found", "Needs facility verification", "Potential planning gap"
NULL_LIKE = "('', 'null', 'none', 'na', 'n/a', 'nan', '-', '--', '[]', '{}', 'unknown', '\"\"', '''''')"
GENERAL = "general_or_unspecified"
PATTERNS = (
    ("explicit_icu", "licen[sc]e"), ("explicit_icu", "copyright"), ("equipment", "[0-9]{3}-[0-9]{4}"), ("procedure", "https?://"), ("procedure", "version"), ("staffing", "[a-z]+@[a-z]+"), ("specialty_context", "public"),
)
DENIAL = "all\\s+rights\\s+reserved"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

#: The rules of names.py in another dialect; generic borders of words are the same in both.
CATEGORY = tuple((name, pattern) for name, pattern in (*CATEGORY_RULES, ("individual_doctor", DOCTOR)))


def window(c: str, pattern: str) -> str:
    around = f"'(?i)([^.;\\n]*?)(?:{pattern})[^.;\\n]*'"
    whole = STRIP.format(f"regexp_extract({c}, {around}, 0)")
    cut = STRIP.format(f"substring({whole}, greatest(length(regexp_extract({c}, {around}, 1)) - 150, 0) + 1, 300)")
    return f"CASE WHEN length({whole}) > 300 THEN {cut} ELSE {whole} END"


def _hits(patterns=PATTERNS, denial: str = DENIAL) -> str:
    out = [f"SELECT unique_id, field, f, i, 0 AS n, 'negation' AS grp, '{denial}' AS pattern, {window('text', denial)} AS text FROM items WHERE denied"]
    for n, (group, p) in enumerate(patterns, 1):
        out.append(f"SELECT unique_id, field, f, i, {n}, '{group}', '{p}', {window('text', p)} FROM items WHERE NOT denied AND regexp_matches(text, '(?i){p}')")
    return " UNION ALL ".join(out)


def _list(field: str, k: int) -> str:
    return f"SELECT unique_id, '{field}', {k}, unnest(range(len({field}))), unnest({field}) FROM rec"


def has(group: str) -> str:
    return f"coalesce(bool_or(grp = '{group}'), false)"


LINES = "string_split(coalesce(text, ''), chr(10))"
#: Everything that the engine works out about a record, one row each in ``judged``.
JUDGED = f"""
rec AS (
  SELECT 'doc-' || lpad(d.doc_id::VARCHAR, 8, '0') AS unique_id, d.lang, d.source, d.text AS description, coalesce(d.n_chars, 0) AS size, l.quality, coalesce(l.toxic = 1, false) AS geo_conflict,
    concat_ws(' ', CASE coalesce(d.n_chars, 0) % 7 WHEN 0 THEN 'Dr.' WHEN 1 THEN 'City hospital' WHEN 2 THEN 'Lab' WHEN 3 THEN 'Dental hospital' WHEN 4 THEN 'Eye hospital' END, d.source, coalesce(d.n_chars, 0)::VARCHAR) AS name,
    [x FOR x IN {LINES} IF contains(x, '@')] AS capability, [x FOR x IN {LINES} IF regexp_matches(x, 'https?://|version')] AS procedure, [x FOR x IN {LINES} IF regexp_matches(x, '[0-9]{{3}}-[0-9]{{4}}')] AS equipment,
    CASE WHEN coalesce(d.n_chars, 0) % 3 <> 0 THEN coalesce(d.n_chars, 0) % 200 END AS capacity, CASE coalesce(d.n_chars, 0) % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'out_of_range' ELSE 'ok' END AS coord_status,
    CASE WHEN coalesce(d.n_chars, 0) % 11 <> 0 THEN d.source END AS district
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
items AS (
  SELECT *, regexp_matches(text, '(?i){DENIAL}') AS denied FROM (
    SELECT unique_id, 'description' AS field, 0 AS f, 0 AS i, {STRIP.format('description')} AS text FROM rec WHERE lower({STRIP.format('description')}) NOT IN {NULL_LIKE}
    UNION ALL {_list('capability', 1)} UNION ALL {_list('procedure', 3)} UNION ALL {_list('equipment', 4)})),
every AS ({_hits()}),
frag AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id, field, grp, text ORDER BY f, i, n) AS r FROM every) WHERE r = 1),
own AS (
  SELECT unique_id, {has('explicit_icu')} AS explicit, {has('equipment')} AS sig_e, {has('procedure')} AS sig_p, {has('staffing')} AS sig_s, {has('specialty_context')} AS sig_c, {has('negation')} AS denied,
    list_sort(list_distinct(coalesce(list(field) FILTER (grp NOT IN ('negation', 'specialty_context')), []))) AS fields, list_distinct(coalesce(list(field) FILTER (grp = 'explicit_icu'), [])) AS claimed,
    count(*) AS n_fragments, bool_or(grp <> 'negation' AND regexp_matches(text, '(?i)creative')) AS foreign_text,
    coalesce(bool_or(grp = 'explicit_icu' AND field = 'description' AND NOT regexp_matches(text, '(?i)creative') AND regexp_matches(text, '(?i)released|under|version') AND len(regexp_extract_all(text, '\\S+')) >= 5), false) AS solid
  FROM frag GROUP BY 1),
kinds AS (
  SELECT unique_id, list_sort(list_distinct(list(k))) AS subtypes FROM (
    SELECT unique_id, unnest(CASE WHEN len(s) = 0 THEN ['{GENERAL}'] ELSE s END) AS k FROM (
      SELECT unique_id, [x FOR x IN [CASE WHEN regexp_matches(text, '(?i)apache|gpl') THEN 'cardiac_icu' END, CASE WHEN regexp_matches(text, '(?i)mit') THEN 'neonatal_icu' END, CASE WHEN regexp_matches(text, '(?i)public') THEN 'surgical_icu' END] IF x IS NOT NULL] AS s
      FROM frag WHERE grp = 'explicit_icu')) GROUP BY 1),
beds AS (SELECT unique_id, max(try_cast(x AS INTEGER)) AS beds FROM (SELECT unique_id, unnest(list_concat(regexp_extract_all(text, '(?i)version\\s+(\\d{{1,4}})', 1), regexp_extract_all(text, '(\\d{{1,4}})\\.\\d', 1))) AS x FROM items) GROUP BY 1),
there AS (SELECT unique_id, bool_or(field = 'description') AS h_d, bool_or(field = 'capability') AS h_c, bool_or(field = 'procedure') AS h_p, bool_or(field = 'equipment') AS h_e FROM items GROUP BY 1),
twice AS (SELECT lower({STRIP.format('name')}) AS k, lower(coalesce(source, '')) AS c FROM rec GROUP BY 1, 2 HAVING count(*) > 1),
a AS (
  SELECT rec.*, coalesce(explicit, false) AS explicit, coalesce(sig_e, false) AS sig_e, coalesce(sig_p, false) AS sig_p, coalesce(sig_s, false) AS sig_s, coalesce(sig_c, false) AS sig_c, coalesce(own.denied, false) AS denied,
    coalesce(fields, []) AS fields, coalesce(claimed, []) AS claimed, coalesce(n_fragments, 0) AS n_fragments, coalesce(foreign_text, false) AS foreign_text, coalesce(solid, false) AS solid, coalesce(subtypes, []) AS subtypes, beds,
    coalesce(h_d, false) AS h_d, coalesce(h_c, false) AS h_c, coalesce(h_p, false) AS h_p, coalesce(h_e, false) AS h_e, twice.k IS NOT NULL AS is_twice
  FROM rec LEFT JOIN own USING (unique_id) LEFT JOIN kinds USING (unique_id) LEFT JOIN beds USING (unique_id) LEFT JOIN there USING (unique_id)
  LEFT JOIN twice ON twice.k = lower({STRIP.format('rec.name')}) AND twice.c = lower(coalesce(rec.source, ''))),
b AS (
  SELECT *, coalesce(capacity > 0 AND beds > capacity, false) AS odd1, coalesce(explicit AND capacity = 0, false) AS odd2,
    [x FOR x IN [CASE WHEN sig_e THEN 'equipment' END, CASE WHEN sig_p THEN 'procedure' END, CASE WHEN sig_s THEN 'staffing' END, CASE WHEN beds IS NOT NULL THEN 'bed_count' END] IF x IS NOT NULL] AS cats,
    explicit AND solid AND len([x FOR x IN claimed IF x <> 'description']) > 0 AS described
  FROM a),
c AS (
  SELECT *,
    [x FOR x IN [CASE WHEN explicit THEN 'explicit_claim' END, CASE WHEN NOT explicit AND sig_c THEN 'specialty_context' END, CASE WHEN sig_e THEN 'equipment' END, CASE WHEN sig_p THEN 'procedure' END, CASE WHEN beds IS NOT NULL THEN 'capacity' END,
      CASE WHEN sig_s THEN 'staffing' END, CASE WHEN explicit AND len(fields) >= 3 THEN 'cross_field_consistency' END, CASE WHEN denied THEN 'negation_penalty' END, CASE WHEN odd1 OR odd2 THEN 'suspicious_penalty' END] IF x IS NOT NULL] AS e_parts,
    [x FOR x IN [CASE WHEN h_d THEN 'description' END, CASE WHEN h_p THEN 'procedure' END, CASE WHEN h_e THEN 'equipment' END, CASE WHEN quality IS NOT NULL THEN 'staffing' END, CASE WHEN capacity IS NOT NULL THEN 'capacity' END,
      CASE WHEN source IS NOT NULL THEN 'source_url' END, CASE WHEN coord_status = 'ok' OR lang IS NOT NULL THEN 'geography' END] IF x IS NOT NULL] AS c_parts,
    [x FOR x IN [CASE WHEN denied THEN 'negated_icu_mention' END, CASE WHEN odd1 THEN 'icu_beds_exceed_total_capacity' END, CASE WHEN odd2 THEN 'icu_claim_with_zero_capacity' END,
      CASE WHEN explicit AND h_d AND len(claimed) > 0 AND len([x FOR x IN claimed IF x NOT IN ('capability', 'specialties')]) = 0 THEN 'icu_claim_not_in_description' END,
      CASE WHEN explicit AND NOT sig_e AND NOT sig_p AND NOT sig_s AND beds IS NULL THEN 'icu_claim_uncorroborated' END, CASE WHEN coord_status = 'out_of_range' THEN 'invalid_coordinates' END,
      CASE WHEN h_d::INT + h_p::INT + h_e::INT + h_c::INT + (capacity IS NOT NULL)::INT + (quality IS NOT NULL)::INT < 2 THEN 'suspiciously_sparse_record' END, CASE WHEN is_twice THEN 'possible_duplicate_facility' END,
      CASE WHEN foreign_text THEN 'directory_or_partner_content_detected' END, CASE WHEN geo_conflict THEN 'state_field_conflicts_with_pin_directory' END] IF x IS NOT NULL] AS flags
  FROM b),
d AS (
  SELECT *, greatest(0, least(100, list_sum([0] || [[35, 20, 20, 15, 10, 10, 10, -40, -15][list_position(['explicit_claim', 'specialty_context', 'equipment', 'procedure', 'capacity', 'staffing', 'cross_field_consistency', 'negation_penalty', 'suspicious_penalty'], x)] FOR x IN e_parts])))::BIGINT AS e,
    list_sum([0] || [[20, 15, 15, 10, 10, 15, 15][list_position(['description', 'procedure', 'equipment', 'staffing', 'capacity', 'source_url', 'geography'], x)] FOR x IN c_parts])::BIGINT AS k,
    list_has_any(flags, ['icu_beds_exceed_total_capacity', 'icu_claim_with_zero_capacity', 'icu_claim_uncorroborated', 'directory_or_partner_content_detected']) AS suspicious, len(cats) AS n_cats
  FROM c),
judged AS (
  SELECT *, CASE WHEN denied THEN '{REVIEW}' WHEN k < 45 THEN '{INSUFFICIENT}' WHEN e >= 45 AND suspicious THEN '{REVIEW}' WHEN e >= 45 AND NOT explicit THEN '{REVIEW}' WHEN e >= 45 AND n_cats >= 2 THEN '{TRUSTED}'
      WHEN e >= 45 AND described AND n_cats >= 1 THEN '{TRUSTED}' WHEN e >= 45 THEN '{REVIEW}' WHEN e <= 15 THEN '{GAP}' ELSE '{REVIEW}' END AS class,
    CASE {' '.join(f"WHEN regexp_matches(name || ' ' || coalesce(lang, ''), '(?i){p}') THEN '{n}'" for n, p in CATEGORY)} ELSE 'unknown' END AS category,
    CASE size % 7 WHEN 0 THEN 'Outpatient / diagnostic context' WHEN 1 THEN 'Likely general-hospital context' WHEN 2 THEN 'Outpatient / diagnostic context' WHEN 3 THEN 'Specialty or limited-scope hospital context'
      WHEN 4 THEN 'Specialty or limited-scope hospital context' ELSE 'Unknown context' END AS context
  FROM d)"""
#: Patterns of the policy with other keyword groups.
OTHER_PATTERNS = (
    ("explicit_icu", "copyright"), ("explicit_icu", "public"), ("equipment", "[0-9]{3}-[0-9]{4}"), ("equipment", "https?://"), ("procedure", "https?://"), ("procedure", "version"), ("staffing", "licen[sc]e"), ("specialty_context", "apache"),
)


def under(name: str, patterns=PATTERNS, denial: str = DENIAL, weights: str = "[35, 20, 20, 15, 10, 10, 10, -40, -15]", high: int = 45, low: int = 15, enough: int = 45) -> str:
    """The records as another policy judges them."""
    own = JUDGED.replace(_hits(), _hits(patterns, denial)).replace(f"'(?i){DENIAL}') AS denied", f"'(?i){denial}') AS denied").replace("[35, 20, 20, 15, 10, 10, 10, -40, -15]", weights)
    own = own.replace("e >= 45", f"e >= {high}").replace("e <= 15", f"e <= {low}").replace("k < 45", f"k < {enough}")
    return f"SELECT * FROM (WITH {own} SELECT unique_id, '{name}' AS policy, e AS evidence, k AS completeness, n_cats AS n_categories, beds::BIGINT AS beds, described, class AS classification FROM judged)"


SWEEP = " UNION ALL ".join((under("present"), under("other_weights", weights="[25, 20, 30, 10, 10, 10, 10, -15, -15]", high=40, low=10, enough=60), under("other_words", OTHER_PATTERNS, "creative")))
MEASURES = f"""count(*) AS facility_count, count(*) FILTER (class = '{TRUSTED}') AS trusted, count(*) FILTER (class = '{REVIEW}') AS review, 100.0 * count(*) FILTER (k >= 45) / count(*) AS pct"""
STATUS = f"CASE WHEN facility_count < 3 OR pct < 40 THEN '{DESERT}' WHEN trusted >= 1 THEN '{FOUND}' WHEN review > 0 THEN '{VERIFY}' ELSE '{PLANNING}' END AS region_status"
DISTRICTS = f"""
dis AS (SELECT *, {STATUS} FROM (SELECT coalesce(lang, '(unassigned)') AS st, coalesce(district, '(unassigned)') AS di, {MEASURES} FROM judged GROUP BY 1, 2)),
sta AS (SELECT *, {STATUS} FROM (SELECT coalesce(lang, '(unassigned)') AS st, {MEASURES} FROM judged GROUP BY 1))"""
LONG = "SELECT '{s}' AS section, metric, NULL::VARCHAR AS key, round(value, 3)::DOUBLE AS value FROM (SELECT {m} FROM {t}) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))"


def long(section: str, measures: dict[str, str], source: str) -> str:
    return LONG.format(s=section, m=", ".join(f"({v})::DOUBLE AS {k}" for k, v in measures.items()), t=source)


def keyed(section: str, metric: str, key: str, source: str, top: int | None = None, value: str = "count(*)") -> str:
    cut = f" ORDER BY count(*) DESC, 3 LIMIT {top}" if top else ""
    return f"SELECT * FROM (SELECT '{section}' AS section, '{metric}' AS metric, coalesce({key}, '(null)') AS key, round({value}, 3)::DOUBLE AS value FROM {source} GROUP BY 3{cut})"


def stats(c: str) -> dict[str, str]:
    return {"n": f"count({c})", "mean": f"avg({c})", "median": f"median({c})", **{f"p{q}": f"quantile_cont({c}, {q / 100})" for q in (5, 25, 50, 75, 95)}, **{f"bin_{i}": f"count(*) FILTER (least(floor({c} / 10.0), 9) = {i})" for i in range(10)}}


GAPS = f"(SELECT * FROM judged WHERE class = '{GAP}') g"
TRUST = f"(SELECT * FROM judged WHERE class = '{TRUSTED}') t"
EDGE = f"(SELECT * FROM judged WHERE class = '{REVIEW}' AND e >= 45 AND explicit AND n_cats = 1 AND k >= 45 AND NOT denied AND NOT suspicious) x"
GAP_AUDIT = " UNION ALL ".join(
    (
        long("gap_records", {"total": "count(*)", "pct_hospital_like": "100.0 * avg((category = 'hospital_like')::INT)", "pct_clearly_non_hospital": "100.0 * avg((category IN ('pharmacy', 'dentist', 'individual_doctor', 'diagnostics_or_lab'))::INT)", "with_source": "count(*) FILTER (source IS NOT NULL)", "with_coordinates": "count(*) FILTER (coord_status = 'ok')", "with_capacity": "count(capacity)"}, GAPS),
        keyed("gap_records", "organization_type", "lang", GAPS, 10), keyed("gap_records", "category", "category", GAPS), keyed("gap_records", "state", "lang", GAPS), keyed("gap_records", "district", "district", GAPS, 20),
        long("gap_records_completeness", stats("k"), GAPS), long("gap_records_evidence", stats("e"), GAPS),
    )
)
CLAIMS = "array_to_string(list_sort(claimed), '+')"
TRUSTED_AUDIT = " UNION ALL ".join(
    (
        long("trusted_records", {"total": "count(*)", "structured_claim_only": "count(*) FILTER (len(claimed) > 0 AND len([x FOR x IN claimed IF x NOT IN ('capability', 'specialties')]) = 0)"}, TRUST),
        long("trusted_records", {"barely_trusted": "count(*) FILTER (e <= 50 OR n_cats <= 2)"}, TRUST),
        keyed("trusted_records", "subtype", "s", f"(SELECT unnest(CASE WHEN len(subtypes) > 0 THEN subtypes ELSE ['(none)'] END) AS s FROM {TRUST})"), keyed("trusted_records", "flag", "s", f"(SELECT unnest(flags) AS s FROM {TRUST})"),
        keyed("trusted_records", "categories", "array_to_string(list_sort(cats), '+')", TRUST), keyed("trusted_records", "claim_fields", CLAIMS, TRUST),
    )
)
REGIONAL = " UNION ALL ".join(
    (
        keyed("regional", "states", "region_status", "sta"), keyed("regional", "districts", "region_status", "dis"), long("regional", {"single_trusted_districts": "count(*) FILTER (trusted = 1 AND di <> '(unassigned)')"}, "dis"),
        "SELECT * FROM (SELECT 'regional' AS section, 'non_hospital_share' AS metric, concat_ws('/', lang, district) AS key, round(avg((category IN ('pharmacy', 'dentist', 'individual_doctor', 'diagnostics_or_lab'))::INT), 3)::DOUBLE AS value FROM judged WHERE district IS NOT NULL GROUP BY 3"
        " HAVING avg((category IN ('pharmacy', 'dentist', 'individual_doctor', 'diagnostics_or_lab'))::INT) >= 0.5 ORDER BY avg((category IN ('pharmacy', 'dentist', 'individual_doctor', 'diagnostics_or_lab'))::INT) DESC, count(*) DESC, 3 LIMIT 20)",
    )
)
PIECES = "(SELECT *, list_contains(claimed, 'description') AS in_text, len(subtypes) > 0 AND NOT list_contains(subtypes, 'general_or_unspecified') AS sub_only FROM " + EDGE + ")"
BOUNDARY = " UNION ALL ".join(
    (
        long("boundary", {"total": "count(*)", "claim_in_description": "count(*) FILTER (in_text)", "claim_only_structured": "count(*) FILTER (NOT in_text)", "with_directory_flag": "count(*) FILTER (foreign_text)", "subtype_only": "count(*) FILTER (sub_only)", "moves_v2a": "count(*) FILTER (solid)", "moves_v2b": "count(*) FILTER (described)", **{f"description_p{q}": f"quantile_cont(length(description), {q / 100})" for q in (25, 50, 75)}}, PIECES),
        keyed("boundary", "category", "cats[1]", EDGE), keyed("boundary", "audit_category", "category", EDGE), keyed("boundary", "state", "lang", EDGE, 10),
    )
)
CAN = "(SELECT * FROM judged WHERE k >= 45) c"
REPORT = " UNION ALL ".join(
    (
        keyed("counts", "classification", "class", "judged"), keyed("counts", "coord_status", "coord_status", "judged"), keyed("counts", "geo_source", "'pin_directory'", "judged"),
        long("judgeability", {
            "judgeable": "count(*)", "missing_capacity": "count(*) FILTER (capacity IS NULL)", "missing_doctors": "count(*) FILTER (quality IS NULL)", "missing_source": "count(*) FILTER (source IS NULL)", "missing_coordinates": "count(*) FILTER (coord_status <> 'ok')",
            "missing_district": "count(*) FILTER (district IS NULL)", "no_relevant_procedure": "count(*) FILTER (NOT sig_p)", "no_relevant_equipment": "count(*) FILTER (NOT sig_e)", "no_explicit_claim": "count(*) FILTER (NOT explicit)",
            "generic_content_only": "count(*) FILTER ((h_p OR h_e) AND NOT sig_p AND NOT sig_e AND NOT explicit)", "judgeable_by_generated_only": "count(*) FILTER (k - 15 * h_p::INT - 15 * h_e::INT < 45)"}, CAN),
        keyed("judgeability", "components", "array_to_string(list_sort(c_parts), '+')", CAN), long("judgeability_completeness", stats("k"), CAN), GAP_AUDIT, TRUSTED_AUDIT, REGIONAL, BOUNDARY,
    )
)
WITH = f"WITH {JUDGED}"
WIDE = f"WITH {JUDGED}, {DISTRICTS}"
RANK = "CASE WHEN denied THEN 3 WHEN e >= 45 AND suspicious THEN 1 WHEN e >= 45 AND explicit THEN 0 ELSE 2 END"
CONTEXT_RANK = "CASE context WHEN 'Likely general-hospital context' THEN 0 WHEN 'Specialty or limited-scope hospital context' THEN 1 WHEN 'Unknown context' THEN 2 ELSE 3 END"
LABELS = [("trusted_general", f"class = '{TRUSTED}' AND list_contains(subtypes, '{GENERAL}')"), ("review", f"class = '{REVIEW}'"), *((f"only_{s}", f"subtypes = ['{s}']") for s in ("neonatal_icu", "pediatric_icu", "cardiac_icu", "medical_icu", "surgical_icu"))]
KINDS = [("data_desert_district", f"region_status = '{DESERT}'"), ("planning_gap_district", f"region_status = '{PLANNING}'"), ("single_trusted_district", f"region_status = '{FOUND}' AND trusted = 1")]
CHECKS = ("coord_status = 'ok' OR (lang IS NOT NULL AND district IS NOT NULL)", "source IS NOT NULL", "capacity IS NOT NULL", "quality IS NOT NULL", "beds IS NOT NULL", "sig_e OR sig_p OR sig_s")
CHECK_NAMES = ("location_resolved", "source_or_provenance", "total_capacity", "doctor_count", "anchored_icu_bed_count", "icu_operational_detail")
GATES = ("k >= 45", "explicit", "e >= 45", "NOT denied", "NOT suspicious", "n_cats >= 2 OR (described AND n_cats >= 1)")
LABEL = f"CASE class WHEN '{TRUSTED}' THEN 'Trusted ICU evidence' WHEN '{GAP}' THEN 'No ICU evidence in judgeable record' ELSE class END"
HUMAN = f"CASE quality WHEN 1 THEN '{TRUSTED}' WHEN 0 THEN '{GAP}' END"
DIRECTORY = """
lines AS (
  SELECT (600000 + l_partkey % 300000)::VARCHAR AS pin, CASE l_returnflag WHEN 'A' THEN 'Kerala' WHEN 'N' THEN 'Odisha' ELSE 'Delhi' END AS st,
    CASE l_linestatus WHEN 'O' THEN '24-Parganas North' ELSE 'Ernakulam' END AS di, l_quantity::DOUBLE AS lat, CASE WHEN l_linenumber <> 6 THEN l_quantity::DOUBLE + 60 END AS lon FROM lineitem),
known AS (SELECT *, lon IS NOT NULL AND lat BETWEEN 6 AND 38 AND lon BETWEEN 68 AND 98 AS ok FROM lines),
modes AS (
  SELECT pin, min(st) FILTER (rs = 1) AS st, min(di) FILTER (rd = 1) AS di FROM (
    SELECT pin, st, di, rank() OVER (PARTITION BY pin ORDER BY ns DESC, st) AS rs, rank() OVER (PARTITION BY pin ORDER BY nd DESC, di) AS rd
    FROM (SELECT pin, st, di, count(*) OVER (PARTITION BY pin, st) AS ns, count(*) OVER (PARTITION BY pin, di) AS nd FROM known)) GROUP BY 1),
pins AS (SELECT pin, any_value(m.st) AS st, any_value(m.di) AS di, avg(lat) FILTER (ok) AS lat, avg(lon) FILTER (ok) AS lon, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(DISTINCT k.st) AS n_st FROM known k JOIN modes m USING (pin) GROUP BY 1)"""
CUSTOMERS = """
cust AS (
  SELECT '6' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS pin, CASE c_mktsegment WHEN 'BUILDING' THEN 'Kerala' WHEN 'MACHINERY' THEN 'Uttar Pradesh' WHEN 'AUTOMOBILE' THEN NULL ELSE 'Jammu and Kashmir' END AS own,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'exact' WHEN 'MACHINERY' THEN 'alias' WHEN 'AUTOMOBILE' THEN 'none' ELSE 'exact' END AS how, c_acctbal::DOUBLE AS lat, c_nationkey::DOUBLE AS lon, 1000 + c_nationkey * 10 AS capacity FROM customer)"""
#: Coordinates of the facilities: both columns are numbers there.
PLACE = "CASE WHEN (lat = 0 AND lon = 0) OR lat NOT BETWEEN 6 AND 38 OR lon NOT BETWEEN 68 AND 98 THEN 'out_of_range' ELSE 'ok' END"

RECORD_SQL = {
    "q_records_scored": f"""{WITH}
SELECT unique_id, e AS evidence, k AS completeness, class AS classification, n_cats AS n_categories, described AS description_corroboration, is_twice AS is_name_duplicate, explicit AS explicit_icu_claim, beds::BIGINT AS beds,
  array_to_string(subtypes, '+') AS subtypes, array_to_string(fields, '+') AS fields, array_to_string(cats, '+') AS categories, array_to_string(list_sort(flags), '+') AS flags, array_to_string(list_sort(e_parts), '+') AS evidence_parts,
  array_to_string(list_sort(c_parts), '+') AS completeness_parts, n_fragments, ((NOT h_d)::INT + (NOT explicit)::INT + (NOT sig_e)::INT + (NOT sig_p)::INT + (NOT sig_s)::INT + (beds IS NULL)::INT)::BIGINT AS n_missing
FROM judged""",
    "q_records_fragments": f"{WITH} SELECT unique_id, field, grp AS signal, pattern, text AS fragment FROM frag",
    "q_validator_flags": f"""{WITH}
SELECT name, CASE WHEN name = 'negated_icu_mention' THEN 'contradiction' WHEN name IN ('icu_beds_exceed_total_capacity', 'icu_claim_with_zero_capacity', 'icu_claim_uncorroborated', 'directory_or_partner_content_detected') THEN 'suspicious' ELSE 'data_quality' END AS severity, count(*) AS n
FROM (SELECT unnest(flags) AS name FROM judged) GROUP BY 1""",
    "q_judgeability": f"""{WITH}
SELECT count(*) AS judgeable, count(*) FILTER (capacity IS NULL) AS missing_capacity, count(*) FILTER (quality IS NULL) AS missing_doctors, count(*) FILTER (source IS NULL) AS missing_source, count(*) FILTER (coord_status <> 'ok') AS missing_coordinates,
  count(*) FILTER (district IS NULL) AS missing_district, count(*) FILTER (NOT sig_p) AS no_relevant_procedure, count(*) FILTER (NOT sig_e) AS no_relevant_equipment, count(*) FILTER (NOT explicit) AS no_explicit_claim,
  count(*) FILTER ((h_p OR h_e) AND NOT sig_p AND NOT sig_e AND NOT explicit) AS generic_content_only, count(*) FILTER (k - 15 * h_p::INT - 15 * h_e::INT < 45) AS judgeable_by_generated_only
FROM judged WHERE k >= 45""",
    "q_gap_audit": f"{WITH} {GAP_AUDIT}",
    "q_trusted_audit": f"{WITH} {TRUSTED_AUDIT}",
    "q_barely_trusted": f"{WITH} SELECT unique_id, e AS evidence FROM judged WHERE class = '{TRUSTED}' AND (e <= 50 OR n_cats <= 2)",
    "q_regional_audit": f"{WIDE} {REGIONAL}",
    "q_boundary": f"{WITH} {BOUNDARY}",
    "q_report": f"{WIDE} {REPORT}",
    "q_priority_worklist": f"""{WIDE},
w AS (
  SELECT st AS state, di AS district, unique_id, context, CASE WHEN class = '{REVIEW}' THEN 1 WHEN class = '{TRUSTED}' AND len(flags) > 0 THEN 2 WHEN class = '{TRUSTED}' THEN 3 WHEN class = '{GAP}' AND region_status = '{PLANNING}' THEN 4 END AS tier,
    CASE WHEN class = '{REVIEW}' THEN {RANK} ELSE -1 END AS r, {CONTEXT_RANK} AS c, CASE WHEN class = '{GAP}' THEN k WHEN class = '{TRUSTED}' AND len(flags) > 0 THEN len(flags) ELSE e END AS strength
  FROM judged JOIN dis ON st = coalesce(lang, '(unassigned)') AND di = coalesce(judged.district, '(unassigned)'))
SELECT state, district, priority, unique_id, context AS facility_context FROM (SELECT *, row_number() OVER (PARTITION BY state, district ORDER BY tier, r, c, strength DESC, unique_id) AS priority FROM w WHERE tier IS NOT NULL) WHERE priority <= 5""",
    "q_facility_table": f"{WITH} SELECT unique_id AS id, name, {LABEL} AS status, e AS evidence, k AS completeness, source AS city FROM judged WHERE class IN ('{TRUSTED}', '{REVIEW}')",
    "q_candidates": f"{WIDE}, l AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS label, unique_id, e FROM judged WHERE {c}" for n, c in LABELS)
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n}', st || '/' || di, facility_count FROM dis WHERE {c}" for n, c in KINDS)
    + ") SELECT label, rank, unique_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY e DESC, unique_id) AS rank FROM l) WHERE rank <= 3",
    "q_operational": f"{WITH}, o AS (SELECT foreign_text, "
    + ", ".join(f"({c}) AS {n}" for n, c in zip(CHECK_NAMES, CHECKS))
    + " FROM judged), q AS (SELECT *, "
    + " + ".join(f"{n}::INT" for n in CHECK_NAMES)
    + " AS n FROM o) SELECT CASE WHEN n >= 5 THEN 'High' WHEN n >= 3 THEN 'Medium' ELSE 'Low' END AS operational_level, foreign_text AS operational_source_warning, count(*) AS n, "
    + ", ".join(f"count(*) FILTER ({n}) AS {n}" for n in CHECK_NAMES)
    + " FROM q GROUP BY 1, 2",
    "q_trust_gates": f"{WITH} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS gate, count(*) FILTER ({c}) AS met, count(*) FILTER (NOT ({c})) AS open FROM judged" for i, c in enumerate(GATES)),
    "q_assessment": f"""{WITH}
SELECT CASE WHEN class IN ('{TRUSTED}', '{GAP}') THEN 'resolved' ELSE 'unresolved' END AS assessment, {LABEL} AS status_label, upper(replace(flags[1], '_', ' ')[1]) || replace(flags[1], '_', ' ')[2:] AS first_flag, count(*) AS n FROM judged GROUP BY 1, 2, 3""",
    "q_policy_change": f"""{WITH}
SELECT class AS classification, CASE WHEN denied THEN '{REVIEW}' WHEN k < 50 THEN '{INSUFFICIENT}' WHEN e >= 60 AND suspicious THEN '{REVIEW}' WHEN e >= 60 AND NOT explicit THEN '{REVIEW}' WHEN e >= 60 AND n_cats >= 2 THEN '{TRUSTED}'
  WHEN e >= 60 AND described AND n_cats >= 1 THEN '{TRUSTED}' WHEN e >= 60 THEN '{REVIEW}' WHEN e <= 20 THEN '{GAP}' ELSE '{REVIEW}' END AS other_classification, count(*) AS n FROM judged GROUP BY 1, 2""",
    "q_extractors": f"""{WITH}, w AS (SELECT unique_id, string_agg(x, '+' ORDER BY x) AS found FROM (SELECT unique_id, concat_ws(':', field, grp, pattern) AS x FROM frag) GROUP BY 1)
SELECT x AS extractor, unique_id, e AS evidence, class AS classification, n_fragments, coalesce(found, '') AS found FROM judged LEFT JOIN w USING (unique_id), (VALUES ('keywords'), ('arrow')) v(x)""",
    "q_run_summary": f"""{WITH}, r AS (
  SELECT *, CASE quality WHEN 1 THEN '{TRUSTED}' WHEN 0 THEN '{GAP}' END AS h, CASE WHEN lang <> 'de' THEN CASE WHEN denied THEN '{REVIEW}' WHEN k < 50 THEN '{INSUFFICIENT}' WHEN e >= 60 AND suspicious THEN '{REVIEW}' WHEN e >= 60 AND NOT explicit THEN '{REVIEW}' WHEN e >= 60 AND n_cats >= 2 THEN '{TRUSTED}'
    WHEN e >= 60 AND described AND n_cats >= 1 THEN '{TRUSTED}' WHEN e >= 60 THEN '{REVIEW}' WHEN e <= 20 THEN '{GAP}' ELSE '{REVIEW}' END END AS m FROM judged),
n AS (
  SELECT count(*) AS rows, count(m) AS model_pairs, round(100.0 * avg((class = m)::INT), 1) AS model_agreement_pct, count(h) AS human_pairs, round(100.0 * avg((class = h)::INT), 1) AS human_agreement_pct,
    count(*) FILTER (class = '{TRUSTED}' AND h <> '{TRUSTED}') AS false_trusted, count(*) FILTER (class = '{GAP}' AND h <> '{GAP}') AS false_gap, avg(capacity) AS mean_latency_ms, sum(capacity) AS total_latency_ms,
    count(*) FILTER (geo_conflict) AS errors, count(*) FILTER (lang = 'fr') AS quarantined FROM r),
q AS (SELECT rows + errors AS requested, errors, round(100.0 * errors / (rows + errors), 1) AS error_pct FROM n)
SELECT 'run' AS section, metric, round(value, 3)::DOUBLE AS value FROM (SELECT COLUMNS(*)::DOUBLE FROM n) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))
UNION ALL SELECT 'requests', metric, round(value, 3)::DOUBLE FROM (SELECT COLUMNS(*)::DOUBLE FROM q) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))
UNION ALL SELECT 'subtypes', s, count(*)::DOUBLE FROM (SELECT unnest(subtypes) AS s FROM judged) GROUP BY ALL""",
    "q_policy_sweep": SWEEP,
    "q_policy_moves": f"""WITH s AS ({SWEEP})
SELECT o.policy, b.classification, o.classification AS other_classification, count(*) AS n FROM s b JOIN s o ON o.unique_id = b.unique_id AND b.policy = 'present' AND o.policy <> 'present' GROUP BY ALL""",
    "q_district_centroids": f"""{WIDE}
SELECT st AS state, di AS district, facility_count, round(median(size), 3)::DOUBLE AS lat, round(median(coalesce(quality, 0)), 3)::DOUBLE AS lon, count(*) AS n_located
FROM judged JOIN dis ON st = lang AND di = district WHERE coord_status = 'ok' GROUP BY 1, 2, 3""",
    "q_planning_example": f"""{WIDE}, f AS (
  SELECT lang AS s, district AS d, count(*) FILTER (context LIKE 'Likely%') AS g, round(avg((context LIKE 'Outpatient%')::INT), 4) AS o, count(*) FILTER (coord_status = 'ok') AS l FROM judged GROUP BY 1, 2)
SELECT region_status, state, district, facility_count FROM (
  SELECT region_status, st AS state, di AS district, facility_count, row_number() OVER (PARTITION BY region_status ORDER BY (region_status = '{PLANNING}' AND facility_count >= 5) DESC,
    CASE WHEN region_status = '{PLANNING}' THEN -g END, CASE WHEN region_status = '{PLANNING}' THEN o END, CASE WHEN region_status = '{PLANNING}' THEN -l END, facility_count DESC, st, di) AS r
  FROM dis LEFT JOIN f ON st = s AND di = d WHERE st <> '(unassigned)' AND di <> '(unassigned)') WHERE r = 1 AND region_status <> '{FOUND}'""",
    "q_region_options": f"{WITH} SELECT DISTINCT coalesce(lang, '(unassigned)') AS state, coalesce(district, '(unassigned)') AS district FROM rec",
    "q_excerpts": f"""{WITH}, t AS (SELECT unique_id, text, min((f, i, n)) AS o FROM frag GROUP BY 1, 2), u AS (SELECT unique_id, list(text[1:160] ORDER BY o) AS l FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY o) AS r FROM t) WHERE r <= 4 GROUP BY 1)
SELECT unique_id, sha256(x) AS excerpt_sha, length(x)::BIGINT AS length FROM (SELECT unique_id, CASE WHEN l IS NOT NULL THEN array_to_string(l, ' | ') ELSE description[1:300] END AS x FROM rec LEFT JOIN u USING (unique_id))""",
    "q_single_state": f"{WITH} SELECT district AS district_final, count(*) AS n FROM rec WHERE lang = 'en' GROUP BY 1",
    "q_text_blocks": f"""{WITH}, p AS (SELECT unique_id, f, '[' || field || ']' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY i) AS b FROM items GROUP BY unique_id, field, f)
SELECT unique_id, sha256(coalesce(b, '')) AS block_sha FROM rec LEFT JOIN (SELECT unique_id, string_agg(b, chr(10) || chr(10) ORDER BY f) AS b FROM p GROUP BY 1) USING (unique_id)""",
    "q_modal_rollup": f"""WITH {DIRECTORY}
SELECT pin AS pincode_clean, st AS pin_state, di AS pin_district, round(lat, 4)::DOUBLE AS pin_lat, round(lon, 4)::DOUBLE AS pin_lon, n AS n_offices, n_ok AS n_valid_coords, n_st AS n_states_seen FROM pins""",
    "q_geography": f"""WITH {DIRECTORY}, {CUSTOMERS}
SELECT coalesce(p.st, own) AS state_final, p.di AS district_final, CASE WHEN p.st IS NOT NULL THEN 'pin_directory' WHEN own IS NOT NULL THEN 'state_field' ELSE 'none' END AS geo_source, coalesce(p.st <> own, false) AS geo_conflict, own AS state_from_field, how AS state_field_method, count(*) AS n
FROM cust LEFT JOIN pins p USING (pin) GROUP BY ALL""",
    "q_value_status": """
SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'missing' WHEN c_nationkey = 3 THEN 'unparseable' WHEN c_acctbal / 100 NOT BETWEEN 6 AND 38 OR c_nationkey + 60 NOT BETWEEN 68 AND 98 THEN 'out_of_range' ELSE 'ok' END AS status, count(*) AS n,
  count(*) FILTER (c_mktsegment <> 'BUILDING' AND c_nationkey <> 3) AS with_lat FROM customer GROUP BY 1, 2""",
    "q_facility_profile": f"""WITH {CUSTOMERS}, p AS (SELECT *, {PLACE} AS status FROM cust), m AS (
  SELECT count(*) AS rows, count(*) FILTER (status = 'ok') AS coordinates_ok, 0 AS coordinates_missing, 0 AS coordinates_unparseable, count(*) FILTER (status = 'out_of_range') AS coordinates_out_of_range, count(own) AS resolvable_states, count(*) AS valid_postal_codes, 0 AS repeated_ids, 0 AS rows_of_repeated_ids FROM p)
SELECT metric, value::BIGINT AS value FROM (SELECT COLUMNS(*)::BIGINT FROM m) UNPIVOT (value FOR metric IN (COLUMNS(*)))""",
    "q_directory_profile": "SELECT count(*) AS n_rows, count(DISTINCT (l_linenumber = 7, 600000 + l_partkey % 300000)) AS distinct_codes, count(DISTINCT l_returnflag) AS distinct_states, 0::BIGINT AS non_numeric_latitudes FROM lineitem",
    "q_indicators": """
SELECT state_raw, CASE WHEN state_raw = 'TAMILNADU' THEN 'Tamil Nadu' ELSE 'West Bengal' END AS state, count(*) AS n, count(p_name) AS named, sum(p_size)::DOUBLE AS sum_a, sum(CASE WHEN p_size % 3 = 2 THEN 1000 + p_size END)::DOUBLE AS sum_b
FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'TAMILNADU' ELSE 'West  Bengal' END AS state_raw FROM part) GROUP BY 1, 2""",
    "q_indicator_profile": "SELECT count(*) AS n_rows, count(*) FILTER (p_size % 3 = 1) AS non_numeric_cells, count(DISTINCT (p_name, p_size % 2)) AS distinct_districts FROM part",
    "q_typed": f"WITH {CUSTOMERS} SELECT {PLACE} AS coord_status, capacity::BIGINT AS capacity, count(*) AS n, 0::BIGINT AS doctors FROM cust GROUP BY 1, 2",
    "q_duplicate_names": """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN lower(trim(substring(p_name, 1, 6))) END AS k, lower(p_brand) AS b FROM part)
SELECT p_partkey, coalesce(k IS NOT NULL AND count(*) OVER (PARTITION BY k, b) > 1, false) AS twice FROM p""",
    "q_run_counters": f"""{WITH}, m AS (SELECT count(*)::DOUBLE AS rows_in, count(*)::DOUBLE AS rows_out, count(*) FILTER (geo_conflict)::DOUBLE AS geo_conflicts, count(lang)::DOUBLE AS states_resolved, count(district)::DOUBLE AS districts_resolved, round(avg(e), 1)::DOUBLE AS mean_evidence, round(avg(k), 1)::DOUBLE AS mean_completeness FROM judged)
SELECT metric, value FROM m UNPIVOT (value FOR metric IN (COLUMNS(*)))""",
    "q_category_errors": f"""{WITH} SELECT lang AS audit_category, count(*) AS n_rows, round(100.0 * avg((class = h)::INT), 1)::DOUBLE AS agreement_pct, count(*) FILTER (class = '{TRUSTED}' AND h <> '{TRUSTED}') AS false_trusted, count(*) FILTER (class = '{GAP}' AND h <> '{GAP}') AS false_gap
FROM (SELECT *, {HUMAN} AS h FROM judged) WHERE h IS NOT NULL AND lang IS NOT NULL GROUP BY 1""",
    "q_subtype_mismatches": f"""{WITH} SELECT unique_id, s AS reviewer_subtype, t AS extractor_subtypes FROM (SELECT unique_id, quality, array_to_string(subtypes, '+') AS t, CASE WHEN geo_conflict THEN 'cardiac_icu' WHEN quality IS NOT NULL THEN 'general' END AS s FROM judged)
WHERE quality IS NOT NULL AND s IS NOT NULL AND NOT contains(t, s)""",
    "q_proposals_verified": f"""{WITH}, q AS (SELECT unique_id, geo_conflict, [x FOR x IN string_split(description, chr(10)) IF regexp_matches(x, '(?i)licen[sc]e')][1] AS quote, lower({STRIP.format('description')}) NOT IN {NULL_LIKE} AS there,
  regexp_extract(description, '[^ \\t-\\r]+') AS word FROM rec WHERE description IS NOT NULL)
SELECT unique_id, ((quote IS NOT NULL)::INT + coalesce(geo_conflict AND w, false)::INT)::BIGINT AS verified, (1 + (geo_conflict AND word = '')::INT)::BIGINT AS dropped, coalesce(geo_conflict AND word <> '' AND NOT w, false)::BIGINT AS low, quote IS NOT NULL AS explicit_icu_claim
FROM (SELECT *, regexp_matches(word, '(?i)licen[sc]e|copyright|[0-9]{{3}}-[0-9]{{4}}|https?://|version|[a-z]+@[a-z]+|public') AS w FROM q)""",
    "q_batch_inputs": "SELECT b AS batch_id, count(*) AS n, min(u) AS first_id, max(u) AS last_id FROM (SELECT u, ((row_number() OVER (ORDER BY u) - 1) // 20)::BIGINT AS b FROM (SELECT 'doc-' || lpad(doc_id::VARCHAR, 8, '0') AS u FROM documents)) GROUP BY 1",
}
