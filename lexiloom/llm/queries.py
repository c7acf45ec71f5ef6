"""The queries opN_<name> over the driver's tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import dealt
from . import chat, exact_dedup, fingerprints, mixing, near_dup, packing, quality, token_counts, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(_read(spark, sf_dir, "documents"), tokenizer_file())


def _fold(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_fold(3) != 1), "quality")
    return quality.scores(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_fold(5) != 0), "toxic")
    return toxicity.scores(docs, model).select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted", "n_segments", "p_value")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), tokenizer_file())


#: conversation -7: a text that holds the template's own control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with an odd id are written as `turns` records, the others as `messages`; both come out alike."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turn = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    tricky = spark.range(1).select(turn.alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(TRICKY).alias("text"))
    out = chat.formatted(chat.canonical(chat.from_rows(rows.unionByName(tricky), F.col("conv_id") % 2 != 0)))
    back = out.withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, coalesce(role, '') = 'assistant' AS loss,
    length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 + 7
    + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\c')) AS chars
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE loss), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages"), URL_RULES)


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '(?s)\A([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '(?s)\A[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), rules(action, h, pre) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(action, length(h || pre)) AS action
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
)
SELECT p.page_id, host, path, rule,
  coalesce(action, CASE WHEN list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills']) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(_read(spark, sf_dir, "documents"))


#: Target shares of tokens by the domains that the labels mark.
DOMAIN_TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    fitted, fit = mixing.rates(_read(spark, sf_dir, "documents"), labels.select("doc_id", domain.alias("domain")), DOMAIN_TARGETS)
    posterior = [F.element_at("posterior", k + 1).alias(f"p_{d}") for k, d in enumerate(DOMAIN_TARGETS)]
    reached = [F.lit(share).alias(f"share_{d}") for share, d in zip(fit.shares, DOMAIN_TARGETS)]
    rows = fitted.select("doc_id", "n_tokens", *posterior, "rate", mixing.draws(F.col("rate"), F.struct("doc_id", "text_key")).alias("draws"), *reached, F.lit(fit.residual).alias("residual"), "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_fingerprints": op6_fingerprints,
        "op7_chat_format": op7_chat_format,
        "op8_packing": op8_packing,
        "op9_url_filter": op9_url_filter,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op7_chat_format": OP7_SQL,
        "op9_url_filter": OP9_SQL,
    }
