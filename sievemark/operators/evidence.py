"""Evidence from text: which patterns match where, each with the source sentence that it matched in.

All within the row: the items of a record are an array, and every pattern is a literal expression
over it, so nothing is shuffled and records of any number are scored where they lie. An item is
searched for the patterns' literals first; the patterns go one by one, each only where one of its
literals stands. If a pattern has none, a single alternation is scanned for first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.literals import folded, holds_any, required, required_by_any
from sievemark.functions.text import any_of, cleaned, list_items, one, stripped
from sievemark.policy import GENERAL_SUBTYPE, GROUPS, TEXT_FIELDS, Keywords, Policy

WINDOW_LIMIT = 300
FRAGMENT = "struct<field:string,group:string,pattern:string,text:string>"
FRAGMENTS = f"array<{FRAGMENT}>"


def _named(field: str):
    return lambda x: F.struct(F.lit(field).alias("field"), x.alias("text"))


def text_items(fields: tuple[str, ...] = TEXT_FIELDS, listed: bool = False) -> Column:
    """The texts of a record in order: array of struct(field, text). With ``listed`` the list
    fields are arrays already, else JSON in strings. The first field is one text."""
    parts = []
    for k, name in enumerate(fields):
        if k == 0:
            text = cleaned(F.col(name))
            items = F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
        else:
            items = F.coalesce(F.col(name), F.array().cast("array<string>")) if listed else list_items(F.col(name))
        parts.append(F.transform(items, _named(name)))
    return F.concat(*parts)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sentence_window(text: Column, pattern: str) -> Column:
    """The sentence around the first match: between full stops, semicolons and line ends. Of longer
    ones, 300 characters from 150 before the match. All searches are anchored, so the work grows
    with the length of the text, whatever stands in it."""

    def around(before: Column) -> Column:
        left = F.reverse(F.regexp_extract(F.reverse(before), r"^[^.;\n]*", 0))
        right = F.regexp_extract(F.substring(text, F.char_length(before) + 1, F.char_length(text)), rf"(?iU)^(?:{pattern})[^.;\n]*", 0)
        return once(F.struct(left.alias("left"), stripped(F.concat(left, right)).alias("whole")), cut)

    def cut(x: Column) -> Column:
        start = F.greatest(F.char_length(x["left"]) - WINDOW_LIMIT // 2, F.lit(0))
        return F.when(F.char_length(x["whole"]) > WINDOW_LIMIT, stripped(F.substring(x["whole"], start + 1, F.lit(WINDOW_LIMIT)))).otherwise(x["whole"])

    return once(F.regexp_extract(text, rf"(?iU)^([\s\S]*?)(?:{pattern})", 1), around)


def _hits(item: Column, group: str, patterns: tuple[str, ...], windows: bool, low: Column) -> Column:
    text = item["text"]
    shown = lambda p: sentence_window(text, p) if windows else F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            *(
                F.when(holds_any(low, required(p)) & text.rlike(one(p)), F.struct(item["field"].alias("field"), F.lit(group).alias("group"), F.lit(p).alias("pattern"), shown(p).alias("text")))
                for p in patterns
            )
        )
    )


def all_fragments(items: Column, keywords: Keywords, windows: bool = True) -> Column:
    """Every match of every pattern, in order of items, groups and patterns. An item that denies
    gives its denials and nothing else. Without ``windows`` the texts are null: enough to count.
    Literals that the patterns can't do without are looked for first."""
    none = F.array().cast(FRAGMENTS)
    wanted = [p for g in GROUPS for p in keywords.group(g)]

    def of(item: Column) -> Column:
        def with_low(low: Column) -> Column:
            sure = lambda p: holds_any(low, required(p)) & item["text"].rlike(one(p))
            denied = reduce(lambda a, p: a | sure(p), keywords.negation, F.lit(False))
            # where every pattern has a literal these say enough, and spare the slow scan for any of the patterns
            literals = required_by_any(wanted)
            some = holds_any(low, literals) if literals else item["text"].rlike(any_of(wanted))
            return (
                F.when(denied, _hits(item, "negation", keywords.negation, windows, low))
                .when(some, F.concat(*(_hits(item, g, keywords.group(g), windows, low) for g in GROUPS)))
                .otherwise(none)
            )

        return once(folded(item["text"]), with_low)

    return F.flatten(F.transform(items, of))


def first_of_each(fragments: Column) -> Column:
    """One fragment for each (field, group, text): the first, so the first pattern counts."""
    key = lambda x: F.struct(x["field"], x["group"], x["text"])
    placed = F.array_sort(F.transform(fragments, lambda f, i: F.struct(f["field"].alias("field"), f["group"].alias("group"), f["text"].alias("text"), i.alias("i"), f["pattern"].alias("pattern"))))
    firsts = once(placed, lambda all_: F.filter(all_, lambda x, j: (j == 0) | ~key(x).eqNullSafe(key(F.get(all_, F.greatest(j - 1, F.lit(0)))))))
    in_order = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), F.struct(x["field"].alias("field"), x["group"].alias("group"), x["pattern"].alias("pattern"), x["text"].alias("text")).alias("f"))))
    return F.transform(in_order, lambda x: x["f"])


def patterns_of(fragments: Column, group: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(fragments, lambda f: f["group"] == group), lambda f: f["pattern"])))


def subtypes(fragments: Column, keywords: Keywords) -> Column:
    """Which kinds the explicit fragments claim; one that names none is general."""

    def of(f: Column) -> Column:
        named = F.array_compact(F.array(*(F.when(f["text"].rlike(any_of(p)), F.lit(name)) for name, p in keywords.subtypes.items())))
        return F.when(F.size(named) == 0, F.array(F.lit(GENERAL_SUBTYPE))).otherwise(named)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(fragments, lambda f: f["group"] == "explicit_icu"), of))))


def anchored_number(texts: Column, patterns: tuple[str, ...]) -> Column:
    """The largest number that any pattern captures in any one text."""
    numbers = lambda t: F.concat(*(F.regexp_extract_all(t, F.lit("(?iU)" + p), F.lit(1)) for p in patterns))
    return F.array_max(F.transform(F.flatten(F.transform(texts, numbers)), lambda x: x.try_cast("int")))


def consistency_flags(explicit: Column, beds: Column, capacity: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when((capacity > 0) & (beds > capacity), F.lit("icu_beds_exceed_total_capacity")),
            F.when(explicit & (capacity == 0), F.lit("icu_claim_with_zero_capacity")),
        )
    )


# Stored names of what a record lacks, in order.
MISSING = (
    "no description text", "no explicit ICU / intensive-care claim", "no ICU-relevant equipment mentioned", "no ICU-relevant procedures mentioned", "no critical-care staffing information", "no ICU bed count",
)


def missing_evidence(items: Column, explicit: Column, signals: dict[str, Column], beds: Column) -> Column:
    described = F.exists(items, lambda x: x["field"] == "description")
    lacking = (~described, ~explicit, *(F.size(signals[g]) == 0 for g in ("equipment", "procedure", "staffing")), beds.isNull())
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in zip(lacking, MISSING))))


def demoted_tags(fragments: Column, keywords: Keywords) -> Column:
    """Explicit fragments that are specialty tags only become context."""

    def of(f: Column) -> Column:
        tag = (f["group"] == "explicit_icu") & f["text"].rlike(any_of(keywords.specialty_context)) & ~f["text"].rlike(any_of(keywords.explicit_icu))
        return F.when(tag, F.struct(f["field"].alias("field"), F.lit("specialty_context").alias("group"), f["pattern"].alias("pattern"), f["text"].alias("text"))).otherwise(f)

    return F.transform(fragments, of)


def extracted(df: DataFrame, policy: Policy = Policy(), listed: bool = False) -> DataFrame:
    """Adds the evidence columns: items, fragments, *_signals, explicit_icu_claim, supporting_fields,
    icu_bed_count, icu_subtypes, contradiction_flags, suspicious_flags, missing_evidence. Needs the
    five text fields and ``capacity_int``."""
    kw = policy.keywords
    # each step stands alone, so that an expression read several times is computed once
    a = df.withColumn("items", text_items(listed=listed))
    b = a.withColumn("_all", all_fragments(F.col("items"), kw))
    c = b.withColumns(
        {
            "fragments": first_of_each(F.col("_all")),
            **{f"{g}_signals": patterns_of(F.col("_all"), g) for g in GROUPS},
            "supporting_fields": F.array_sort(F.array_distinct(F.transform(F.filter("_all", lambda f: ~f["group"].isin("negation", "specialty_context")), lambda f: f["field"]))),
            "contradiction_flags": F.when(F.exists("_all", lambda f: f["group"] == "negation"), F.array(F.lit("negated_icu_mention"))).otherwise(F.array().cast("array<string>")),
            "icu_bed_count": anchored_number(F.transform("items", lambda x: x["text"]), kw.bed_count),
        }
    )
    return finished(c.drop("_all").withColumn("explicit_icu_claim", F.size("explicit_icu_signals") > 0), policy, F.array().cast("array<string>"))


def finished(df: DataFrame, policy: Policy, found_flags: Column) -> DataFrame:
    """The part that any extractor's evidence goes through: subtypes, consistency, what is missing."""
    beds, explicit = F.col("icu_bed_count"), F.col("explicit_icu_claim")
    return df.withColumns(
        {
            "icu_subtypes": subtypes(F.col("fragments"), policy.keywords),
            "suspicious_flags": F.concat(found_flags, consistency_flags(explicit, beds, F.col("capacity_int"))),
            "missing_evidence": missing_evidence(F.col("items"), explicit, {g: F.col(f"{g}_signals") for g in GROUPS}, beds),
        }
    )


def contract(df: DataFrame, fragments: DataFrame, id_column: str = "unique_id") -> DataFrame:
    """Evidence from another extractor: ``fragments`` holds (id, field, group, pattern, text, ord)
    rows, however made; they are put in order and joined to their records."""
    lists = fragments.groupBy(F.col(id_column).alias("_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "field", "group", "pattern", "text"))), lambda x: F.struct(x["field"].alias("field"), x["group"].alias("group"), x["pattern"].alias("pattern"), x["text"].alias("text"))).alias("fragments")
    )
    return df.join(lists.hint("merge"), F.col(id_column) == F.col("_id"), "left").drop("_id").withColumn("fragments", F.coalesce("fragments", F.array().cast(FRAGMENTS)))


def display_order(fragments: Column, limit: int = 5) -> Column:
    """The fragments that a reader should see first: denials, claims, equipment, procedures, staff, context."""
    order = ("negation", "explicit_icu", "equipment", "procedure", "staffing", "specialty_context")
    rank = lambda f: reduce(lambda acc, kv: F.when(f["group"] == kv[1], F.lit(kv[0])).otherwise(acc), list(enumerate(order))[::-1], F.lit(len(order)))
    ranked = F.transform(fragments, lambda f, i: F.struct(rank(f).alias("r"), i.alias("i"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(ranked), 1, limit), lambda x: x["f"])
