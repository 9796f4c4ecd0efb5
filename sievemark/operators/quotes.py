"""Quotes found in any of many texts, wherever they begin and end, with white space of any kind and
length between their words.

A quote of three words or more must have its inner words as whole words in a text that holds it; one of
two words has the last characters of its first and the first of its second side by side; one of a
single word stands inside a word of the vocabulary. Each text is read once for such keys, and only those
that some quote has leave it. The rarest key of each quote, counted over all texts, names the texts to
search for it whole. Texts and quotes that are blank or null hold and find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.text import stripped
from sievemark.operators.proposals import collapsed, located
from sievemark.sources.tables import written

#: Words of a key's run, characters of a key at the border of words, and marks sent to all tasks at most.
RUN, EDGE, MARKS = 3, 3, 1 << 18


def words(c: Column) -> Column:
    """The words of a text; none of a blank or null one."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), "")


def _run(w: Column, n: int):
    """The key of the ``n`` words from a place on, by the place."""
    return lambda i: F.xxhash64(F.lit(n), *(F.get(w, i + k) for k in range(n)))


def _edge(w: Column, left: int, right: int):
    """The key of the border behind the word at a place, by the place."""
    return lambda i: F.xxhash64(F.lit(-(10 * left + right)), F.right(F.get(w, i), F.lit(left)), F.left(F.get(w, i + 1), F.lit(right)))


def _at_each(w: Column, span: int, key) -> Column:
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) >= span, F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(span)), key)).otherwise(none)


def keys_of_text(w: Column, runs: list[int], edges: list[tuple[int, int]]) -> Column:
    """The distinct keys of a text's words, of the kinds that the quotes have."""
    lists = [_at_each(w, n, _run(w, n)) for n in runs] + [_at_each(w, 2, _edge(w, *e)) for e in edges]
    return F.array_distinct(F.concat(*lists)) if lists else F.array().cast("array<bigint>")


def keyed_quotes(quotes: DataFrame, quote_id: str, quote: str) -> DataFrame:
    """q (known by id and quote), quote_id, quote, its number of words, the kind of its keys (run, left,
    right) and all its ``keys``."""
    w = F.col("_w")
    n = quotes.select(F.xxhash64(F.col(quote_id), F.col(quote)).alias("q"), F.col(quote_id).alias("quote_id"), F.col(quote).alias("quote"), words(F.col(quote)).alias("_w")).withColumn("n", F.size("_w")).where("n > 0")
    run = F.when(F.col("n") > 2, F.least(F.col("n") - 2, F.lit(RUN)))
    edge = lambda c: F.when(F.col("n") == 2, F.least(F.char_length(c), F.lit(EDGE)))
    kinds = n.withColumns({"run": run, "left": edge(F.get(w, F.lit(0))), "right": edge(F.get(w, F.lit(1)))})
    inner = F.slice(w, 2, F.greatest(F.col("n") - 2, F.lit(0)))
    keys = F.lit(None).cast("array<bigint>")
    for k in range(1, RUN + 1):
        keys = F.when(F.col("run") == k, _at_each(inner, k, _run(inner, k))).otherwise(keys)
    for a in range(1, EDGE + 1):
        for b in range(1, EDGE + 1):
            keys = F.when((F.col("left") == a) & (F.col("right") == b), F.array(_edge(w, a, b)(F.lit(0)))).otherwise(keys)
    return kinds.withColumn("keys", F.array_distinct(keys)).select("q", "quote_id", "quote", "n", "run", "left", "right", "keys")


def _inside_words(texts: DataFrame, single: DataFrame) -> DataFrame:
    """q and key (of a run of one) for every word of the vocabulary that holds a one-word quote."""
    vocabulary = texts.select(F.explode("w").alias("word")).distinct()
    # runs of EDGE characters of a word, or the word itself; a quote is met by its first
    grams = lambda c, g: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1))
    found = None
    for g in range(1, EDGE + 1):
        q = single.where(F.char_length("_s") == g if g < EDGE else F.char_length("_s") >= g).select("q", "_s", F.substring("_s", 1, g).alias("gram"))
        v = vocabulary.select("word", F.explode(F.array_distinct(grams(F.col("word"), g))).alias("gram"))
        some = v.join(q.hint("merge"), "gram").where(F.contains("word", "_s")).select("q", F.xxhash64(F.lit(1), "word").alias("key"))
        found = some if found is None else found.unionByName(some)
    return found


def found_quotes(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str) -> DataFrame:
    """quote_id, quote, text_id and ``found``, the text's own words, for each distinct quote of an id and
    each row of ``texts`` that holds it. Ids may repeat or be null."""
    asked = written(keyed_quotes(quotes, quote_id, quote), "quotes")
    kinds = asked.select("n", "run", "left", "right").select(F.least("n", F.lit(3)).alias("n"), "run", "left", "right").distinct().collect()  # some fifteen at most
    single = any(r["n"] == 1 for r in kinds)
    runs = sorted({r["run"] for r in kinds if r["run"]} | ({1} if single else set()))
    edges = sorted({(r["left"], r["right"]) for r in kinds if r["left"]})
    listed = texts.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(text_id), F.col(text)).alias("t"), words(F.col(text)).alias("w"))
    wanted = asked.where(F.col("keys").isNotNull()).select("q", F.explode("keys").alias("key"))
    if single:
        wanted = wanted.unionByName(_inside_words(listed, asked.where("n = 1").select("q", stripped(F.col("quote")).alias("_s"))))
    wanted = written(wanted, "quote-keys")
    # at most MARKS marks, however many quotes there are
    marks = wanted.select(F.pmod("key", F.lit(MARKS)).alias("_m")).distinct()
    keys = listed.select("t", F.explode(keys_of_text(F.col("w"), runs, edges)).alias("key"))
    hits = keys.withColumn("_m", F.pmod("key", F.lit(MARKS))).join(F.broadcast(marks), "_m", "left_semi").drop("_m")
    hits = written(hits.join(wanted.select("key").distinct().hint("merge"), "key", "left_semi"), "quote-hits")
    seen = hits.groupBy("key").agg(F.count(F.lit(1)).alias("_texts"))
    counted = wanted.join(seen.hint("merge"), "key", "left").join(asked.select("q", "n").distinct().hint("merge"), "q")
    # any key of a one-word quote may be its word; of the others the rarest will do
    rarest = counted.where("n > 1").groupBy("q").agg(F.min_by("key", F.struct(F.coalesce("_texts", F.lit(0)), "key")).alias("key"))
    chosen = rarest.unionByName(counted.where("n = 1").select("q", "key"))
    pairs = hits.join(chosen.hint("merge"), "key").select("q", "t").distinct()
    near = pairs.join(asked.select("q", "quote_id", "quote").distinct().hint("merge"), "q")
    met = near.join(texts.select(F.xxhash64(F.col(text_id), F.col(text)).alias("t"), F.col(text_id).alias("text_id"), F.col(text).alias("_body")).hint("merge"), "t")
    return met.withColumn("found", located("quote", "_body")).where(F.col("found").isNotNull()).select("quote_id", "quote", "text_id", "found")
