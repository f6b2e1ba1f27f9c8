"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    bpe,
    centroids,
    chat_format,
    divergence,
    exact_dedup,
    line_dedup,
    mixing,
    quality_model,
    quality_rules,
    simhash,
    token_counts,
    token_files,
    url_filters,
)
from tickloom.llm.common import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), "ranks")
JSON = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
#: The same as the library reads a text by default: special strings in it are special ids.
LIBRARY = bpe.Vocabulary(JSON.path, special=True)
#: Rules of the URL query, as host and path, and what they say.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: The vocabulary's own end-of-text id.
END_OF_TEXT = 50256


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), LIBRARY, 0)


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), RANKS)
    listed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    digests = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), listed.alias("ids_sha256"), "ids")
    back = bpe.decode(digests, RANKS)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "flat")
    listing = token_counts.write_flat(table(spark, sf_dir, "documents"), folder, JSON, END_OF_TEXT)
    counted = token_counts.scan(spark, folder, END_OF_TEXT)
    return listing.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens")


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), index=simhash.CLOSE)


@query(
    "op10_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


@query(
    "op4_mixing",
    r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            md5(coalesce(doc_id::VARCHAR, 'null')) AS digest
        FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    placed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS place FROM sums),
    weighed AS (
        SELECT source, source_size, [5, 2, 1][place + 1] AS weight, [1.0, 0.5, 1.5][place + 1]::DOUBLE AS strength,
            [0.0, 1.0, -1.0][place + 1]::DOUBLE AS slope, 3 * source_size AS cap
        FROM placed),
    ranked AS (
        SELECT *, cap::DOUBLE / weight AS brim,
            row_number() OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, source) AS nth
        FROM weighed),
    levels AS (
        SELECT nth, brim, ((SELECT sum(source_size) FROM sums)
                - sum(cap) OVER (ORDER BY nth) + cap)::DOUBLE
            / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM ranked),
    aimed AS (
        SELECT *, least(cap::DOUBLE, weight * (SELECT min_by(level, nth) FROM levels WHERE level <= brim)) AS target
        FROM ranked),
    laid AS (
        SELECT s.*, a.source_size, a.target, a.strength, a.slope, round(a.target)::BIGINT AS due,
            (sum(size) OVER (PARTITION BY s.source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start_word
        FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
    taken AS (
        SELECT *, CASE WHEN source_size > 0 THEN (due // source_size) * size
                + greatest(0, least(due - (due // source_size) * source_size - start_word, size)) ELSE 0 END AS taken
        FROM laid),
    passed AS (
        SELECT *, CASE WHEN taken > 0 THEN (taken - 1) // size + 1 ELSE 0 END AS passes FROM taken),
    shares AS (
        SELECT *, least(1.0, start_word::DOUBLE / target) AS share,
            least(1.0, (start_word + (passes - 1) * source_size)::DOUBLE / target) AS last_share
        FROM passed)
    SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, passes::BIGINT AS passes,
        CASE WHEN taken > 0 THEN round(least(1.0, CASE WHEN share = 0 THEN 0 ELSE
            2 * share / (strength + sqrt(strength * strength + 2 * slope * share)) END), 6) END AS first_position,
        CASE WHEN taken > 0 THEN round(least(1.0, CASE WHEN last_share = 0 THEN 0 ELSE
            2 * last_share / (strength + sqrt(strength * strength + 2 * slope * last_share)) END), 6) END AS last_position
    FROM shares
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.tally(mixing.schedule(mixing.assign(table(spark, sf_dir, "documents"))))
    positions = [F.round(c, 6).alias(c) for c in ("first_position", "last_position")]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", *positions)


@query("op6_url_filters", url_filters.oracle(RULES))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), RULES)


@query(
    "op2_chat_format",
    r"""
    WITH given AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    turns AS (
        SELECT *, lag(role) OVER w AS earlier, row_number() OVER w AS place,
            6 + 8 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'))
                + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS chars
        FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    checked AS (
        SELECT *, CASE WHEN place = 1 THEN role IN ('system', 'user')
            ELSE (earlier, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS fine
        FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(chars)::BIGINT AS formatted_chars,
        bool_and(fine) AND max_by(role, place) = 'assistant' AS valid
    FROM checked GROUP BY conv_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return chat_format.read_back(chat_format.format_turns(given.unionByName(planted)))


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decisions(table(spark, sf_dir, "documents"))
    removed = F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines")
    return found.select("doc_id", "n_lines", "n_removed", "n_links", removed)


@query("op11_centroid_clusters", centroids.oracle(k=8, rounds=10, seed=3, dim=64, scale=1024))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dim=64, scale=1024)


@query("op12_source_divergence", divergence.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_quality_model")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
