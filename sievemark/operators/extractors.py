"""Extractors as plug-ins over Arrow batches: texts go in, fragments come out, and the rest of the way to
scores and classes is the engine's own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.literals import FOLDED, required
from sievemark.operators.evidence import FRAGMENTS, WINDOW_LIMIT, anchored_number, contract, finished, first_of_each, patterns_of, text_items
from sievemark.policy import GROUPS, TEXT_FIELDS, Keywords, Policy

#: What a plug-in gets: one row for each text of a record.
ITEMS = "unique_id string, ord int, field string, text string"
#: What it returns, in any number of batches: one row for each fragment.
FOUND = pa.schema([("unique_id", pa.string()), ("field", pa.string()), ("group", pa.string()), ("pattern", pa.string()), ("text", pa.string()), ("ord", pa.int64())])
KNOWN_GROUPS = (*GROUPS, "negation")
Extractor = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def checked(run: Extractor) -> Extractor:
    """The plug-in with its output held against the schema: names, types, no nulls, known fields and groups."""

    def safe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            if b.schema.names != FOUND.names or any(f.type != g.type for f, g in zip(b.schema, FOUND)):
                raise TypeError(f"an extractor must return {FOUND}, not {b.schema}")
            for name, allowed in (("field", TEXT_FIELDS), ("group", KNOWN_GROUPS)):
                if odd := set(b.column(name).unique().to_pylist()) - set(allowed):
                    raise ValueError(f"an extractor returned the unknown {name} {sorted(map(str, odd))}")
            if any(c.null_count for c in b.columns):
                raise ValueError("an extractor returned a fragment with a missing value")
            yield b

    return safe


def plugged(run: Extractor, policy: Policy = Policy(), listed: bool = False) -> Callable[[DataFrame], DataFrame]:
    """An extractor for ``scored`` from a plug-in. Fragments meet their records by a shuffle on the id."""

    def extract(records: DataFrame) -> DataFrame:
        items = records.withColumn("items", text_items(listed=listed))
        texts = items.select("unique_id", F.posexplode("items").alias("ord", "_item")).select("unique_id", "ord", F.col("_item.field").alias("field"), F.col("_item.text").alias("text"))
        found = texts.mapInArrow(checked(run), "unique_id string, field string, group string, pattern string, text string, ord long")
        a = contract(items, found).withColumnRenamed("fragments", "_all")
        claimed = F.filter("_all", lambda f: ~f["group"].isin("negation", "specialty_context"))
        b = a.withColumns(
            {
                "fragments": first_of_each(F.col("_all")), **{f"{g}_signals": patterns_of(F.col("_all"), g) for g in GROUPS},
                "supporting_fields": F.array_sort(F.array_distinct(F.transform(claimed, lambda f: f["field"]))),
                "contradiction_flags": F.when(F.exists("_all", lambda f: f["group"] == "negation"), F.array(F.lit("negated_icu_mention"))).otherwise(F.array().cast("array<string>")),
                "icu_bed_count": anchored_number(F.transform("items", lambda x: x["text"]), policy.keywords.bed_count),
            }
        )
        return finished(b.drop("_all").withColumn("explicit_icu_claim", F.size("explicit_icu_signals") > 0), policy, F.array().cast("array<string>"))

    return extract


def keyword_plugin(keywords: Keywords) -> Extractor:
    """The keyword scan as a plug-in: every pattern of every group over the batch's texts, in which literals
    that the pattern can't do without are searched first."""
    groups = [(g, [(p, re.compile(p, re.I), required(p)) for p in keywords.group(g)]) for g in KNOWN_GROUPS]

    def folded(text: str) -> str:
        for odd, plain in zip(*FOLDED):
            text = text.replace(odd, plain)
        return text.lower()

    def sentence(text: str, m: re.Match) -> str:
        left = max(text.rfind(c, 0, m.start()) for c in ".;\n") + 1
        ends = [k for k in (text.find(c, m.end()) for c in ".;\n") if k >= 0]
        whole = text[left : min(ends, default=len(text))]
        if len(whole.strip()) <= WINDOW_LIMIT:
            return whole.strip()
        # cut from 150 before the match on, in the sentence as it is shown
        return whole.strip()[max(0, m.start() - left - WINDOW_LIMIT // 2) :][:WINDOW_LIMIT].strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in FOUND]
            for uid, ord_, field, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                low = folded(text)
                hits = {g: [(p, m) for p, rx, literals in rxs if (not literals or any(x in low for x in literals)) and (m := rx.search(text))] for g, rxs in groups}
                some = {"negation": hits["negation"]} if hits["negation"] else {g: hits[g] for g in GROUPS}
                n = 0
                for g, found in some.items():
                    for p, m in found:
                        for column, value in zip(out, (uid, field, g, p, sentence(text, m), (ord_ << 16) + n)):
                            column.append(value)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND)], schema=FOUND)

    return run
