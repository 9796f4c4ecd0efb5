"""Extractors against human labels, and against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import stripped
from sievemark.policy import GAP, TRUSTED

HUMAN, PREDICTED = "human_expected_classification", "current_classification"
EXTRACTORS = {"deterministic": "current_classification", "llm_assisted": "llm_classification", "codex_assisted": "codex_classification"}


def filled(c: Column) -> Column:
    return c.isNotNull() & (stripped(c) != "")


def labelled(df: DataFrame, human: str = HUMAN) -> DataFrame:
    return df.where(filled(F.col(human)))


def percent(cond: Column) -> Column:
    """Share of the rows in percent; null, not zero, where there are none."""
    return F.round(100.0 * F.avg(cond.cast("double")), 1)


def confusion(df: DataFrame, human: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(human).alias("human"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, human: str, predicted: str) -> DataFrame:
    """Precision, recall and support of every class on either side; null where nothing is divided by."""
    each = df.select(F.explode(F.array_distinct(F.array(human, predicted))).alias("label"), F.col(human).alias("_h"), F.col(predicted).alias("_p"))
    h, p = F.col("_h") == F.col("label"), F.col("_p") == F.col("label")
    return each.groupBy("label").agg(
        F.round(F.try_divide(F.count_if(h & p), F.count_if(p)), 3).alias("precision"),
        F.round(F.try_divide(F.count_if(h & p), F.count_if(h)), 3).alias("recall"),
        F.count_if(h).alias("support"),
    )


def _errors(human: Column, predicted: Column, trusted=TRUSTED, gap=GAP) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        percent(predicted == human).alias("agreement_pct"),
        F.count_if((predicted == trusted) & (human != trusted)).alias("false_trusted"),
        F.count_if((predicted == gap) & (human != gap)).alias("false_gap"),
    ]


def agreement(df: DataFrame, human: str = HUMAN, extractors: dict[str, str] = EXTRACTORS, keys: list[str] | None = None, trusted=TRUSTED, gap=GAP) -> DataFrame:
    """Agreement and directional errors of every extractor that there is, over the rows that it has."""
    known = labelled(df, human)
    cells = F.array(*(F.struct(F.lit(name).alias("extractor"), F.col(c).alias("predicted")) for name, c in extractors.items() if c in df.columns))
    each = known.select(*(keys or []), F.col(human).cast("string").alias("_h"), F.inline(cells)).where(filled(F.col("predicted")))
    return each.groupBy("extractor", *(keys or [])).agg(*_errors(stripped(F.col("_h")), stripped(F.col("predicted")), trusted, gap))


def progress(df: DataFrame, human: str = HUMAN) -> DataFrame:
    done = F.count_if(filled(F.col(human)))
    return df.agg(F.count(F.lit(1)).alias("rows_total"), done.alias("rows_labelled"), (F.count(F.lit(1)) - done).alias("rows_pending"))


def by_category(df: DataFrame, category: str = "audit_category", human: str = HUMAN, predicted: str = PREDICTED) -> DataFrame:
    known = labelled(df, human).where(filled(F.col(category)))
    return known.groupBy(stripped(F.col(category)).alias(category)).agg(*_errors(stripped(F.col(human)), stripped(F.col(predicted))))


def subtype_mismatches(df: DataFrame) -> DataFrame:
    """Rows whose reviewer named a subtype that the extractor's list doesn't hold."""
    known = labelled(df).where(filled(F.col("subtype")))
    inside = F.lower(F.coalesce("extractor_subtypes", F.lit(""))).contains(F.lower(stripped(F.col("subtype"))))
    return known.where(~inside).select("unique_id", F.col("subtype").alias("reviewer_subtype"), "extractor_subtypes")


def differing(df: DataFrame, human: str = HUMAN, predicted: str = PREDICTED) -> DataFrame:
    return labelled(df, human).where(stripped(F.col(human)) != stripped(F.col(predicted)))


def comparison(results: DataFrame, baseline: DataFrame, other: DataFrame | None = None, id_column: str = "unique_id") -> DataFrame:
    """A model's results beside the baseline's and, where it has them, a second model's."""
    names = ["classification", "capability_evidence_score"]
    out = results.join(baseline.select(id_column, *(F.col(c).alias("baseline_" + c) for c in names)), id_column, "left")
    if other is not None:
        second = other.where(F.col("classification").isNotNull()).select(id_column, *(F.col(c).alias("other_" + c) for c in names))
        out = out.join(second, id_column, "left")
    return out


def comparison_summary(compared: DataFrame) -> DataFrame:
    gap = F.abs(F.col("capability_evidence_score") - F.col("baseline_capability_evidence_score"))
    return compared.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("baseline_classification").alias("pairs"),
        percent(F.when(F.col("baseline_classification").isNotNull(), F.col("classification") == F.col("baseline_classification"))).alias("agreement_pct"),
        F.round(F.avg(gap), 2).alias("mean_score_difference"),
        F.sum("verified_fragments").alias("verified_fragments"),
        F.sum("dropped_fragments").alias("dropped_fragments"),
        F.sum("low_information_fragments").alias("low_information_fragments"),
    )


def subtype_distribution(results: DataFrame, column: str = "icu_subtypes") -> DataFrame:
    """How often each subtype was found."""
    return results.select(F.explode(column).alias("subtype")).groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))


def error_rate(results: DataFrame, errors: DataFrame) -> DataFrame:
    """requested, errors, error_pct of a run (null without a request)."""
    a, b = results.agg(F.count(F.lit(1)).alias("_ok")), errors.agg(F.count(F.lit(1)).alias("errors"))
    both = a.join(F.broadcast(b), F.lit(True)).withColumn("requested", F.col("_ok") + F.col("errors"))  # one row each
    return both.select("requested", "errors", F.round(F.try_divide(100.0 * F.col("errors"), F.col("requested")), 1).alias("error_pct"))


def run_summary(rows: DataFrame, errors: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """One row about an evaluation run: counts, agreement (null without pairs), errors only where
    labels exist, latency, and how many records were set apart."""
    human, mine, model = F.col("human_label"), F.col("classification"), F.col("model_classification")
    some = lambda c: filled(c)
    a = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(some(model)).alias("model_pairs"),
        percent(F.when(some(model), mine == model)).alias("model_agreement_pct"),
        F.count_if(some(human)).alias("human_pairs"),
        percent(F.when(some(human), mine == human)).alias("human_agreement_pct"),
        F.nullif(F.count_if(some(human)), F.lit(0)).alias("_labels"),
        F.count_if(some(human) & (mine == TRUSTED) & (human != TRUSTED)).alias("_ft"),
        F.count_if(some(human) & (mine == GAP) & (human != GAP)).alias("_fg"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.sum("latency_ms").alias("total_latency_ms"),
    )
    b = errors.agg(F.count(F.lit(1)).alias("errors"))
    if quarantined is not None:
        b = b.join(F.broadcast(quarantined.agg(F.count(F.lit(1)).alias("quarantined"))), F.lit(True))  # one row each
    known = F.col("_labels").isNotNull()
    return a.join(F.broadcast(b), F.lit(True)).withColumns({"false_trusted": F.when(known, F.col("_ft")), "false_gap": F.when(known, F.col("_fg"))}).drop("_labels", "_ft", "_fg")  # one row each
