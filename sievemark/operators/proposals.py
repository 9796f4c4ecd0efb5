"""Evidence that a model proposes: a table of payloads, none of it believed before its quotes are
found in the source text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.text import any_of, stripped
from sievemark.operators.clean import duplicate_keys
from sievemark.operators.evidence import FRAGMENTS, anchored_number, demoted_tags, finished, once, text_items
from sievemark.operators.scoring import judged
from sievemark.policy import GROUPS, TEXT_FIELDS, Policy
from sievemark.sources.tables import shared_folder

ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_-]{5,63}$"
PROPOSAL = (
    "unique_id string, explicit_icu_claim boolean, icu_bed_count int, icu_subtypes array<string>, "
    "fragments array<struct<field:string,group:string,quote:string>>, unclear_claims array<string>, explanation string"
)
PROPOSAL_KEYS = ("unique_id", "explicit_icu_claim", "icu_bed_count", "icu_subtypes", "fragments", "unclear_claims", "explanation")
LIMITS = {"fragments": 20, "unclear_claims": 10, "icu_subtypes": 6}
EXPLANATION_LIMIT = 500
PROPOSED_GROUPS = ("explicit_icu", "equipment", "procedure", "staffing", "negation")


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID_PATTERN), F.lit(False))


def split_by(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rows that don't): the good table and the quarantine."""
    ok = F.coalesce(cond, F.lit(False))
    return df.where(ok), df.where(~ok)


def batches(df: DataFrame, id_column: str, size: int, folder: str | None = None) -> DataFrame:
    """Adds ``batch_id``: consecutive runs of ``size`` rows in id order. Ids are ranked in ranges: each
    task numbers its own, after the counts of the tasks before it (one number a task). The split of
    ids among tasks comes from a sample, so it is drawn once and written in ``folder`` (else in the
    shared folder of the session), and counts and rows are read from there."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, id_column).sortWithinPartitions(id_column).withColumns({"_part": F.spark_partition_id(), "_w": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    path = f"{folder or shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    ordered.write.parquet(path)
    placed = spark.read.parquet(path)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(before), F.col("_p") == F.col("_part"))  # a row for each task
    return numbered.withColumn("batch_id", F.floor((F.col("_before") + F.col("_w")) / size)).select(*df.columns, "batch_id")


def batch_inputs(df: DataFrame, id_column: str, size: int, fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """One JSON text for each batch, with the evidence fields only: no names, places or scores."""
    rows = batches(df.select(id_column, *fields), id_column, size)
    lists = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(id_column, *fields))).alias("records"))
    return lists.select("batch_id", "n", F.transform("records", lambda r: r[id_column]).alias("ids"), F.to_json(F.struct("records")).alias("payload"))


def _of_field(name: str):
    return lambda x: x["field"] == name


def text_block(items: Column, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """The non-empty fields of a record as ``[field]`` and bullet lines."""

    def of(all_: Column) -> Column:
        blocks = []
        for name in fields:
            own = F.transform(F.filter(all_, _of_field(name)), lambda x: F.concat(F.lit("- "), x["text"]))
            blocks.append(F.when(F.exists(all_, _of_field(name)), F.concat(F.lit(f"[{name}]\n"), F.array_join(own, "\n"))))
        return F.concat_ws("\n\n", *blocks)

    # the items are worked out once, not once for each field
    return once(items, of)


def collapsed(c: Column) -> Column:
    return F.regexp_replace(stripped(c), r"(?U)\s+", " ")


def located(quote: str, source: str) -> Column:
    """The source's own text where the quote stands in it, however the white space differs; null if it
    doesn't, or if the quote is blank. Takes column names."""
    # plain searches, for the quote's words and then for the collapsed quote, spare most rows the collapsing of
    # their source and the regular expression of their own
    sought = collapsed(F.col(quote))
    likely = (sought != "") & F.forall(F.split(sought, " "), lambda w: F.contains(F.col(source), w))
    there = F.when(likely, collapsed(F.col(source)).contains(sought))
    parts = rf"transform(split(regexp_replace(`{quote}`, '(?U)^\\s+|\\s+$', ''), '(?U)\\s+'), t -> concat('\\Q', replace(t, '\\E', '\\E\\\\E\\Q'), '\\E'))"
    found = F.expr(rf"regexp_extract(`{source}`, concat('(?U)', array_join({parts}, '\\s+')), 0)")
    return F.when(there, F.nullif(found, F.lit("")))


def informative(c: Column, policy: Policy = Policy()) -> Column:
    """Two words or more, or one that is a keyword."""
    kw = policy.keywords
    keywords = any_of([p for g in ("explicit_icu", "equipment", "procedure", "staffing", "specialty_context") for p in kw.group(g)])
    return (F.size(F.regexp_extract_all(c, F.lit(r"((?U)\S+)"), F.lit(1))) >= 2) | c.rlike(keywords)


def parsed_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Payload texts (``batch_id``, one JSON object a row) as proposals with ``valid`` and ``reason``:
    unknown keys, wrong types, too long lists and malformed JSON are each told apart."""
    t = raw.withColumns({"_keys": F.json_object_keys(column), "_p": F.from_json(column, PROPOSAL)})
    fragment_keys = F.from_json(F.get_json_object(column, "$.fragments"), "array<map<string,string>>")
    odd_fragment = F.coalesce(F.exists(fragment_keys, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*(F.lit(k) for k in ("field", "group", "quote"))))) > 0), F.lit(False))
    reason = (
        F.when(stripped(F.col(column)) == "", "empty response")
        .when(F.col("_keys").isNull(), "malformed JSON")
        .when(F.size(F.array_except("_keys", F.array(*(F.lit(k) for k in PROPOSAL_KEYS)))) > 0, "unknown keys")
        .when(odd_fragment, "unknown keys in a fragment")
        .when(F.col("_p.unique_id").isNull() | F.col("_p.explicit_icu_claim").isNull(), "required value missing or of a wrong type")
    )
    for name, most in LIMITS.items():
        reason = reason.when(F.size(f"_p.{name}") > most, f"more than {most} {name}")
    reason = reason.when(F.char_length("_p.explanation") > EXPLANATION_LIMIT, "explanation too long")
    return t.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).select(*raw.columns, "_p.*", "valid", "reason")


def accounted(requested: DataFrame, returned: DataFrame, id_column: str = "unique_id") -> DataFrame:
    """Every requested id of a batch must come back once: one row for each id with its ``problem``
    (null, duplicate, unknown, missing), and whether its batch has any."""
    a = requested.groupBy("batch_id", id_column).agg(F.count(F.lit(1)).alias("_asked"))
    b = returned.groupBy("batch_id", id_column).agg(F.count(F.lit(1)).alias("_given"))
    both = a.join(b, ["batch_id", id_column], "full_outer")
    problem = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_given").isNull(), "missing").when(F.col("_given") > 1, "duplicate")
    marked = both.withColumn("problem", problem)
    bad = marked.groupBy("batch_id").agg(F.bool_or(F.col("problem").isNotNull()).alias("batch_has_problems"))
    return marked.join(bad, "batch_id").select("batch_id", id_column, "problem", "batch_has_problems")


def verified(records: DataFrame, proposals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Records with the evidence columns, from proposals for them. A fragment stays if its field and
    group are known, its quote stands in that field, and it says something; the claim stays if an
    explicit fragment does; the bed count if one fragment bears it out."""
    kw = policy.keywords
    items = records.withColumn("items", text_items())
    sources = items.select(F.col("unique_id").alias("_id"), F.posexplode("items").alias("_ord", "_item")).select("_id", "_ord", F.col("_item.field").alias("_field"), F.col("_item.text").alias("_source"))
    quotes = proposals.select("unique_id", F.posexplode("fragments").alias("ord", "f")).select("unique_id", "ord", F.col("f.field").alias("field"), F.col("f.group").alias("group"), F.coalesce("f.quote", F.lit("")).alias("quote"))
    known = quotes.withColumn("_known", F.col("group").isin(*PROPOSED_GROUPS) & F.col("field").isin(*TEXT_FIELDS))
    met = known.join(sources.hint("merge"), (F.col("unique_id") == F.col("_id")) & (F.col("field") == F.col("_field")) & F.col("_known"), "left").withColumn("_text", located("quote", "_source"))
    # the first item that holds the quote
    first = met.groupBy("unique_id", "ord", "field", "group").agg(F.min(F.when(F.col("_text").isNotNull(), F.struct("_ord", "_text")))["_text"].alias("text"))
    state = F.when(F.col("text").isNull(), "dropped").when(~informative(F.col("text"), policy), "low").otherwise("kept")
    kept = F.struct("ord", "field", "group", F.lit("llm").alias("pattern"), "text")
    lists = first.withColumn("_state", state).groupBy(F.col("unique_id").alias("_id")).agg(
        F.count_if(F.col("_state") == "dropped").alias("n_dropped"),
        F.count_if(F.col("_state") == "low").alias("n_low"),
        F.sort_array(F.collect_list(F.when(F.col("_state") == "kept", kept))).alias("_kept"),
    )
    plain = F.transform("_kept", lambda x: F.struct(x["field"].alias("field"), x["group"].alias("group"), x["pattern"].alias("pattern"), x["text"].alias("text")))
    p = proposals.select(F.col("unique_id").alias("_pid"), F.col("explicit_icu_claim").alias("_claim"), F.col("icu_bed_count").alias("_beds"), F.col("icu_subtypes").alias("proposed_subtypes"), F.slice("unclear_claims", 1, 10).alias("unclear_claims"), F.nullif("explanation", F.lit("")).alias("explanation"))
    joined = items.join(p, F.col("unique_id") == F.col("_pid")).join(lists.hint("merge"), F.col("unique_id") == F.col("_id"), "left").withColumns(
        {"fragments": F.coalesce(plain, F.array().cast(FRAGMENTS)), "n_dropped": F.coalesce("n_dropped", F.lit(0)), "n_low": F.coalesce("n_low", F.lit(0))}
    )
    texts = lambda g: F.transform(F.filter("fragments", lambda f: f["group"] == g), lambda f: F.substring(f["text"], 1, 80))
    signals = {f"{g}_signals": texts(g) for g in GROUPS if g != "specialty_context"}
    a = joined.withColumns(
        {
            **signals,
            "supporting_fields": F.array_sort(F.array_distinct(F.transform(F.filter("fragments", lambda f: f["group"] != "negation"), lambda f: f["field"]))),
            "contradiction_flags": F.when(F.exists("fragments", lambda f: f["group"] == "negation"), F.array(F.lit("negated_icu_mention"))).otherwise(F.array().cast("array<string>")),
        }
    )
    b = a.withColumn("fragments", demoted_tags(F.col("fragments"), kw))
    anchored = anchored_number(F.transform("fragments", lambda f: f["text"]), kw.bed_count)
    c = b.withColumns({"specialty_context_signals": texts("specialty_context"), "explicit_icu_claim": F.coalesce(F.col("_claim"), F.lit(False)) & F.exists("fragments", lambda f: f["group"] == "explicit_icu"), "icu_bed_count": anchored})
    found = F.array_compact(
        F.array(
            F.when(F.col("n_dropped") > 0, F.concat(F.lit("llm_unverified_fragments_dropped:"), F.col("n_dropped").cast("string"))),
            F.when(F.col("n_low") > 0, F.concat(F.lit("llm_low_information_fragments_dropped:"), F.col("n_low").cast("string"))),
            F.when(F.col("icu_bed_count").isNotNull() & (F.col("_beds") != F.col("icu_bed_count")), F.lit("llm_bed_count_mismatch")),
            F.when(F.col("icu_bed_count").isNull() & F.col("_beds").isNotNull(), F.lit("llm_bed_count_unanchored")),
        )
    )
    return finished(c, policy, found).drop("_pid", "_claim", "_beds", "_id", "_kept")


def scored_proposals(records: DataFrame, proposals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The verified proposals through the same validators, scores and classes as all records."""
    marked = records if "is_name_duplicate" in records.columns else duplicate_keys(records, ["name", "address_city"], "is_name_duplicate")
    out = judged(verified(marked, proposals, policy), policy)
    return out.withColumns({"verified_fragments": F.size("fragments"), "dropped_fragments": F.col("n_dropped"), "low_information_fragments": F.col("n_low")})


def unfinished(records: DataFrame, completed: DataFrame, id_column: str = "unique_id") -> DataFrame:
    """What a resumed run still has to do: ids without a completed result."""
    return records.join(completed.select(id_column).distinct(), id_column, "left_anti")


def incompatibilities(manifest: DataFrame, current: dict[str, str]) -> DataFrame:
    """field, recorded, current: what forbids to go on with a run."""
    rows = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("recorded"), F.lit(v).alias("current")) for k, v in current.items()))
    return manifest.select(F.inline(rows)).where(~F.col("recorded").eqNullSafe(F.col("current")))


def spend(usage: DataFrame, policy: Policy = Policy(), limit: float | None = None) -> DataFrame:
    """The cost of the tokens in and out, and whether it is above the limit."""
    cost = F.coalesce(F.sum(F.col("tokens_in") * policy.input_cost_per_mtok + F.col("tokens_out") * policy.output_cost_per_mtok) / 1e6, F.lit(0.0))
    out = usage.agg(F.count(F.lit(1)).alias("records"), cost.alias("cost_usd"))
    return out if limit is None else out.withColumn("over_limit", F.col("cost_usd") > limit)
