"""Exact duplicates: groups of one 128-bit content hash, told apart by their bytes.

Texts are equal when identical after each run of white space ``[\\x20\\x09-\\x0D]+`` becomes one
space; null counts as empty. Rows are grouped by MD5 and then by the bytes themselves, combined in
each task before the shuffle, so a group of any size leaves one row a task. Texts that share a
hash but not their bytes stay apart, each with its own SHA-256.

Of equal texts the row with the smallest id stays, null ids last. Of repeated rows with that id
one stays. An empty table gives no rows. Columns other than the two named are not read by
``decisions``; ``kept_rows`` returns all of them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def variants(texts: DataFrame, digest: Callable[[Column], Column] = md5) -> DataFrame:
    """One row per different text of ``texts`` (id, text): hash, sha, keep_id, group_size."""
    grouped = texts.groupBy(digest(F.col("text")).alias("hash"), "text")
    return grouped.agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select(
        "hash", _sha(F.col("text")).alias("sha"), "keep_id", "group_size"
    )


def decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = md5
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(docs[id_col].alias("id"), normal(docs[text_col]).alias("text"))
    rows = texts.groupBy("id", digest(F.col("text")).alias("hash"), _sha(F.col("text")).alias("sha"))
    rows = rows.agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(variants(texts, digest), ["hash", "sha"])
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    text = normal(docs[text_col])
    rows = docs.select(
        F.struct("*").alias("row"), docs[id_col].alias("id"), md5(text).alias("hash"), _sha(text).alias("sha")
    )
    stay = variants(docs.select(docs[id_col].alias("id"), text.alias("text"))).drop("group_size")
    same = (rows["hash"] == stay["hash"]) & (rows["sha"] == stay["sha"]) & rows["id"].eqNullSafe(stay["keep_id"])
    chosen = rows.join(stay, same, "left_semi")
    one = chosen.groupBy("hash", "sha", "id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")
