"""The queries of this package's operators over the whole given tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import chat_format, collocations, ctw, hard_negatives, license_scan, mixing, near_dedup, packing, quality_rules, rlz_dedup, suffix_dedup, token_files, topk
from sievemark.llm.shared import scratch_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.duplicate_spans(_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.digests(spark.read.parquet(path))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.judged(quality_rules.ledger(_documents(spark, sf_dir)))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_upper", "n_lines", "fail_bits")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id",
        # what isn't finite stays so, and takes no part
        F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(x.cast("double") * 64).cast("double"))).alias("embedding"),
    )
    return topk.top_k(whole, whole.where(F.col("vec_id") % 20 == 0), 20)


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_documents(spark, sf_dir))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(_documents(spark, sf_dir))


def op7_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.removed(_documents(spark, sf_dir))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.order_of(_documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_documents(spark, sf_dir)).drop("tie")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(_documents(spark, sf_dir))
    return found.withColumn("rank", F.col("rank").cast("long"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        # what isn't finite stays so, and takes no part
        F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(x.cast("double") * 256).cast("double"))).alias("embedding"),
    )
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.formatted(turns.unionByName(extra)), in_order=True)


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_token_files, op3_quality_rules, op4_exact_topk, op5_dart_minhash, op6_context_tree, op7_rlz_dedup, op8_pfair_mixing, op9_best_fit_packing, op10_license_scan, op11_phrase_collocations, op12_hard_negatives, op13_chat_format)
}

ORACLE_SQL = {
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^ \t-\r]+') AS words,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \t-\r]')] AS lines
  FROM d),
g AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w))),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '\P{Lu}', '', 'g'))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_upper, n_lines, fail_bits
FROM f""",
    "op7_rlz_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM t),
k AS (
  SELECT x.r, count(g.p) AS n_removed, sha256(coalesce(string_agg(x.v, ' ' ORDER BY x.p) FILTER (g.p IS NULL), '')) AS kept_sha256
  FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS v FROM d) x LEFT JOIN g ON x.r = g.r AND x.p = g.p GROUP BY x.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r""",
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op11_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (
  SELECT lang, k AS words, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, i, unnest(range(1, 6)) AS k FROM o) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE words > 1),
s AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, a
  FROM (SELECT lang, words, ws, a, k, unnest(range(1, words - k + 2)) AS i FROM (SELECT lang, words, ws, a, unnest(range(2, words)) AS k FROM c))),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.a >= 100 * c.a)),
cut AS (
  SELECT k.lang, k.phrase, k.words, k.cut, k.a, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * k.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS cut FROM kept) k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.cut], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.cut + 1:], ' ')
  JOIN t ON t.lang = k.lang),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS q FROM cut)
SELECT lang, rank, phrase, a, l, r, n, score, CAST(words AS INTEGER) AS words, CAST(cut AS INTEGER) AS cut
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m WHERE q = 1) WHERE rank <= 2000""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS key, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.key, a.vec_id AS anchor_id, c.vec_id, c.label, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id, label) AS prank FROM s WHERE same) WHERE prank <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, s.label AS negative_label,
         row_number() OVER (PARTITION BY p.key, p.prank ORDER BY s.score DESC, s.vec_id, s.label) AS rank
  FROM p JOIN s ON s.key = p.key AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, negative_label FROM n WHERE rank <= 10""",
    "op13_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*SAYS\]|\[\\*/ROLE\]')) AS escapes,
         len(regexp_extract_all(role, '<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*SAYS\]|\[\\*/ROLE\]')) AS role_escapes
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + escapes + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) + role_escapes END)::BIGINT AS formatted_chars,
       bool_and(coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' END, FALSE))
         AND bool_or(place = n AND role = 'assistant') AS valid
FROM e GROUP BY conv_id""",
}
