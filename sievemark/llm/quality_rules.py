"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps what was measured and one bit for
each rule that failed. A policy is a named set of rules, that is a mask: applying one, or finding
what a rule alone rejects, are bit operations on the ledger and never read a text again.

Native Spark expressions only. Nothing is shuffled: all counts are made within the row.

Defined results: a null or empty text has no words and fails ``too_few_words``; repeated rows and
ties are judged alike, each on its own; an empty table gives an empty ledger; other columns are
left out, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """Production thresholds; shares are in percent and compared in whole numbers."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_mean_length: int = 2
    max_mean_length: int = 20
    max_symbol_percent: int = 30
    max_dup_line_percent: int = 50
    max_upper_percent: int = 60


#: Rule names in the order of their bits.
RULES = ("too_few_words", "repeated_words", "word_length", "symbols", "repeated_lines", "capitals")
BASE = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...] = field(default=BASE)

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {1: Policy(1, BASE), 2: Policy(2, RULES)}
CURRENT = POLICIES[2]


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds the measurements to the ``keep`` columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    # The steps stand in selects of their own: what a lambda reads several times is computed before it.
    a = docs.select(
        *(F.col(c) for c in keep),
        t.alias("_t"),
        F.array_remove(F.split(t, SPACE), "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    n = F.size("_w")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2])),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    b = a.select(
        *(F.col(c) for c in keep),
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    done = [*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    # most texts repeat no window: only the others sort (hash, place) pairs
    c = b.select(
        *done,
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    d = c.select(
        *done,
        F.when(
            F.col("_s").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size("_s") - 1),
                        lambda j: F.coalesce(F.get("_s", j - 1)["h"] == F.get("_s", j)["h"], F.lit(False))
                        | F.coalesce(F.get("_s", j + 1)["h"] == F.get("_s", j)["h"], F.lit(False)),
                    ),
                    lambda j: F.get("_s", j)["i"],
                )
            ),
        ).alias("_p"),
    )
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["total"] + F.least(F.lit(3), x - acc["last"])).alias("total"), x.alias("last")),
        lambda acc: acc["total"],
    )
    # handed out by a generator of one row: a filter on the measurements stays above it, else it would be
    # pushed down and carry a copy of all these expressions for each time that it names one
    found = F.struct(*(F.col(c) for c in done[len(keep) :]), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return d.select(*keep, F.inline(F.array(found)))


def failures(limits: Limits = Limits()) -> dict[str, Column]:
    """When each rule fails, on the measurements."""
    n = F.col("n_words")
    return {
        "too_few_words": n < limits.min_words,
        "repeated_words": 100 * F.col("n_repeat_words") > limits.max_repeat_percent * n,
        "word_length": (F.col("word_chars") < limits.min_mean_length * n) | (F.col("word_chars") > limits.max_mean_length * n),
        "symbols": 100 * F.col("n_symbols") > limits.max_symbol_percent * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > limits.max_dup_line_percent * F.col("n_lines"),
        "capitals": 100 * F.col("n_upper") > limits.max_upper_percent * F.col("word_chars"),
    }


def ledger(docs: DataFrame, limits: Limits = Limits(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: the measurements and ``fail_bits``."""
    found = failures(limits)
    bits = F.lit(0)
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(found[rule], F.lit(1 << k)).otherwise(F.lit(0)))
    return measured(docs, text, keep).withColumn("fail_bits", bits.cast("long"))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def judged(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Applies a policy to the ledger: ``base_failed`` and ``kept``."""
    base = ~passes(POLICIES[1])
    return book.withColumns({"base_failed": base, "kept": ~base & passes(policy), "policy_version": F.lit(policy.version)})


def ablations(book: DataFrame, policies: dict[int, Policy] = POLICIES) -> DataFrame:
    """For each policy and rule of it: how many documents fail the rule, and how many the rule alone
    rejects. The ledger is first counted by its bits, at most 2**rules groups."""
    counts = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("_n"))
    cases = F.array(
        *(
            F.struct(F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).cast("long").alias("mask"), F.lit(1 << RULES.index(r)).cast("long").alias("bit"))
            for p in policies.values()
            for r in p.rules
        )
    )
    rows = counts.select("fail_bits", "_n", F.explode(cases).alias("c"))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.col("c.mask")) == F.col("c.bit")
    return rows.groupBy(F.col("c.version").alias("policy_version"), F.col("c.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("_n")).otherwise(0)).cast("long").alias("n_failed"),
        F.sum(F.when(alone, F.col("_n")).otherwise(0)).cast("long").alias("n_only_this"),
    )


def filtered(docs: DataFrame, policy: Policy = CURRENT, limits: Limits = Limits()) -> DataFrame:
    """The documents that the policy keeps, all their columns as they were."""
    columns = docs.columns
    inner = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), docs["text"].alias("text"))
    book = judged(ledger(inner, limits, keep=("_row",)), policy)
    return book.where("kept").select(*(F.col("_row")[c].alias(c) for c in columns))
