"""What-if over whole policies: one extraction writes a ledger of signals for each record, and any
number of policies, other keyword groups, weights and thresholds among them, are scored on it at once.

The ledger holds an entry for each pattern (of all policies together) in each item that it matches:
item, field, number of the pattern, a hash of the sentence around the match, and bits that say for each
vocabulary of statements and of foreign organisations whether that sentence speaks their language. It
holds the largest number by each pattern of numbers, and the record's own facts, and no text. Policies
are rows of a small literal table; their weights and thresholds are columns beside the ledger's, so that
all of them run through the same expressions in one pass.
"""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import any_of, one
from sievemark.operators import scoring
from sievemark.operators.evidence import anchored_number, consistency_flags, sentence_window, text_items
from sievemark.policy import GROUPS, CompletenessWeights, EvidenceWeights, Keywords, Policy, Thresholds

RECORD_FACTS = ("capacity_int", "number_doctors_int", "source_urls", "coord_status", "state_final")
ENTRY = "array<struct<item:int,field:string,p:int,text:bigint,states:bigint,foreign:bigint>>"
#: Vocabularies of one kind fit the bits of a number.
MOST_VOCABULARIES = 62


class Vocabulary:
    """The distinct patterns of several policies, and where each policy's stand among them."""

    def __init__(self, policies: dict[str, Policy]):
        words = [p.keywords for p in policies.values()]
        distinct = lambda values: list(dict.fromkeys(values))
        self.patterns = distinct(x for k in words for g in (*GROUPS, "negation") for x in k.group(g))
        self.numbers = distinct(x for k in words for x in k.bed_count)
        self.foreign = distinct(k.cross_organization for k in words)
        self.statements = distinct(self.statement(k) for k in words)
        if max(len(self.foreign), len(self.statements)) > MOST_VOCABULARIES:
            raise ValueError(f"more than {MOST_VOCABULARIES} vocabularies of one kind: build a second ledger")

    @staticmethod
    def statement(k: Keywords) -> tuple:
        return k.service_verbs, k.unit_statements, k.operational_details, k.cross_organization

    def ids(self, patterns: tuple[str, ...]) -> list[int]:
        return [self.patterns.index(p) for p in patterns]


def _bits(conditions: list[Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for i, c in enumerate(conditions):
        total = total + F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return total


def ledger(records: DataFrame, policies: dict[str, Policy], listed: bool = False, id_column: str = "unique_id") -> DataFrame:
    """One row a record: its id, ``entries``, ``numbers``, ``present`` (the fields that hold text), and
    the record's own facts."""
    v = Vocabulary(policies)
    by_statement = [replace(Policy(), keywords=replace(Keywords(), service_verbs=a, unit_statements=b, operational_details=c, cross_organization=d)) for a, b, c, d in v.statements]

    def entries_of(item: Column, i: Column) -> Column:
        text = item["text"]
        seen = F.array_compact(F.array(*(F.when(text.rlike(one(p)), F.struct(F.lit(k).alias("p"), sentence_window(text, p).alias("t"))) for k, p in enumerate(v.patterns))))
        entry = lambda x: F.struct(
            i.cast("int").alias("item"), item["field"].alias("field"), x["p"].alias("p"), F.xxhash64(x["t"]).alias("text"),
            _bits([scoring.substantive(x["t"], p) for p in by_statement]).alias("states"), _bits([x["t"].rlike(any_of(c)) if c else F.lit(False) for c in v.foreign]).alias("foreign"),
        )
        return F.when(text.rlike(any_of(v.patterns)), F.transform(seen, entry)).otherwise(F.array().cast(ENTRY))

    texts = F.transform("items", lambda x: x["text"])
    return records.withColumn("items", text_items(listed=listed)).select(
        id_column, *RECORD_FACTS, F.array_distinct(F.transform("items", lambda x: F.struct(x["field"].alias("field")))).alias("present"),
        F.flatten(F.transform("items", entries_of)).alias("entries"), F.array(*(anchored_number(texts, (p,)) for p in v.numbers)).cast("array<int>").alias("numbers"),
    )


def _ints(values) -> Column:
    return F.array(*(F.lit(x) for x in values)).cast("array<int>")


def policy_rows(policies: dict[str, Policy]) -> Column:
    """The policies as an array of structs, to be exploded beside a ledger that was built for them."""
    v = Vocabulary(policies)
    rows = []
    for name, p in policies.items():
        k = p.keywords
        own = {g: v.ids(k.group(g)) for g in (*GROUPS, "negation")}
        values = {"policy": F.lit(name), **{g: _ints(x) for g, x in own.items()}}
        values |= {f"own_{g}": _ints([x for x in own[g] if x not in own["explicit_icu"]]) for g in ("equipment", "procedure", "staffing")}
        values |= {"beds": _ints([v.numbers.index(x) for x in k.bed_count]), "states_bit": F.lit(v.statements.index(v.statement(k))), "foreign_bit": F.lit(v.foreign.index(k.cross_organization))}
        for prefix, part in (("e", p.evidence_weights), ("c", p.completeness_weights), ("t", p.thresholds)):
            values |= {f"{prefix}_{f.name}": F.lit(getattr(part, f.name)) for f in fields(part)}
        rows.append(F.struct(*(c.alias(n) for n, c in values.items())))
    return F.array(*rows)


def _columns(kind, prefix: str):
    return kind(**{f.name: F.col(f"_p.{prefix}_{f.name}") for f in fields(kind)})


def scored_under(book: DataFrame, policies: dict[str, Policy], id_column: str = "unique_id") -> DataFrame:
    """One row a record and policy: id, policy, evidence, completeness, n_categories, explicit_icu_claim,
    icu_bed_count, described, classification."""
    view = Policy(evidence_weights=_columns(EvidenceWeights, "e"), completeness_weights=_columns(CompletenessWeights, "c"), thresholds=_columns(Thresholds, "t"))
    of = lambda g: lambda e: F.array_contains(F.col(f"_p.{g}"), e["p"])
    a = book.select("*", F.explode(policy_rows(policies)).alias("_p")).withColumn("_denied", F.array_distinct(F.transform(F.filter("entries", of("negation")), lambda e: e["item"])))
    b = a.withColumn("_open", F.filter("entries", lambda e: ~F.array_contains("_denied", e["item"])))
    c = b.withColumns({f"_{g}": F.filter("_open", of(g)) for g in GROUPS})

    def independent(g: str) -> Column:
        """Of each sentence in a field the first pattern counts: is any such pattern none of the claim's?"""
        placed = F.array_sort(F.transform(f"_{g}", lambda e: F.struct(e["field"].alias("field"), e["text"].alias("text"), e["item"].alias("item"), F.array_position(F.col(f"_p.{g}"), e["p"]).alias("at"), e["p"].alias("p"))))
        first = lambda all_: F.exists(F.filter(all_, lambda x, j: (j == 0) | (x["field"] != F.get(all_, F.greatest(j - 1, F.lit(0)))["field"]) | (x["text"] != F.get(all_, F.greatest(j - 1, F.lit(0)))["text"])), lambda x: F.array_contains(F.col(f"_p.own_{g}"), x["p"]))
        return F.element_at(F.transform(F.array(placed), first), 1)

    has_bit = lambda e, field, at: F.call_function("shiftright", e[field], F.col(f"_p.{at}")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    numbers = F.array_max(F.transform(F.col("_p.beds"), lambda i: F.get("numbers", i)))
    claimed = [f"_{g}" for g in ("explicit_icu", "equipment", "procedure", "staffing")]
    d = c.withColumns(
        {
            "explicit_icu_claim": F.size("_explicit_icu") > 0, "icu_bed_count": numbers,
            **{f"{g}_signals": F.transform(f"_{g}", lambda e: e["p"]) for g in GROUPS if g != "explicit_icu"},
            "supporting_fields": F.array_distinct(F.transform(F.concat(*claimed), lambda e: e["field"])),
            "contradiction_flags": F.when(F.size("_denied") > 0, F.array(F.lit("negated_icu_mention"))).otherwise(F.array().cast("array<string>")),
            "_categories": F.array_compact(F.array(*(F.when(independent(g), F.lit(g)) for g in ("equipment", "procedure", "staffing")), F.when(numbers.isNotNull(), F.lit("bed_count")))),
            "_foreign": F.exists(F.concat(*claimed, "_specialty_context"), lambda e: has_bit(e, "foreign", "foreign_bit")),
            "_solid": F.exists("_explicit_icu", lambda e: (e["field"] == "description") & has_bit(e, "states", "states_bit")) & F.exists("_explicit_icu", lambda e: e["field"] != "description"),
            "items": F.col("present"),
        }
    )
    e = d.withColumn("suspicious_flags", consistency_flags(F.col("explicit_icu_claim"), F.col("icu_bed_count"), F.col("capacity_int")))
    bare = (F.size("equipment_signals") == 0) & (F.size("procedure_signals") == 0) & (F.size("staffing_signals") == 0) & F.col("icu_bed_count").isNull()
    f = e.withColumns(
        {
            "_evidence": scoring.clamped(scoring.evidence_components(view)), "_completeness": scoring.clamped(scoring.completeness_components(view)),
            "_suspicious": (F.size("suspicious_flags") > 0) | (F.col("explicit_icu_claim") & bare) | F.col("_foreign"), "_n": F.size("_categories"),
        }
    )
    name, _ = scoring.classified(F.size("contradiction_flags") > 0, F.col("_suspicious"), F.col("_evidence"), F.col("_completeness"), F.col("explicit_icu_claim"), F.col("_n"), F.col("_solid"), view)
    return f.select(
        id_column, F.col("_p.policy").alias("policy"), F.col("_evidence").alias("evidence"), F.col("_completeness").alias("completeness"), F.col("_n").alias("n_categories"),
        "explicit_icu_claim", "icu_bed_count", F.col("_solid").alias("described"), name.alias("classification"),
    )


def moves(scored: DataFrame, base: str, id_column: str = "unique_id") -> DataFrame:
    """How many records each other policy moves from class to class: policy, classification (of ``base``),
    other_classification, n."""
    kept = scored.groupBy(id_column).agg(F.max(F.when(F.col("policy") == base, F.col("classification"))).alias("_base"), F.collect_list(F.struct("policy", "classification")).alias("_each"))
    each = kept.select("_base", F.explode(F.filter("_each", lambda x: x["policy"] != base)).alias("x"))
    return each.groupBy(F.col("x.policy").alias("policy"), F.col("_base").alias("classification"), F.col("x.classification").alias("other_classification")).agg(F.count(F.lit(1)).alias("n"))
