"""Text quality by hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's tokens are its runs of letters (lower-cased), runs of digits and runs of other visible
characters. Words and pairs of neighbours are hashed into ``2**bits`` buckets; a feature's value is
the square root of its share of the tokens, so a text of any length weighs alike. Tokens that stand
for a form rather than a word are counted beside them: a word in capitals, a word equal to one of the
two words before, a triple of tokens seen earlier in the text.

Training takes rows with labels that ``learns`` admits: rows whose crc32(id as text) mod 3 is 1 are
held out. Of these at most ``sample`` ids, the smallest by hash, are used, and of rows that repeat an
id the one with the least text. They are dealt by hash over as many shards as ``shard_rows`` go into
them; each shard runs FTRL-proximal over its rows for some epochs, in an order fixed by hash, and the
shards' weights are averaged. A shard has about ``shard_rows`` rows at every size of the corpus, and
the model has 2**bits weights, which the driver holds and hands to the tasks. Reruns give the same
weights: they are summed as integers.

A score is the logistic function of a sparse dot product. Labels, language, source and id are not
inputs of it. Null and empty texts have no tokens and score by the intercept alone. Null ids are not
held out and have no labels; ids with labels of both kinds, or with null ones, are not learned from.
Without any label every score is 0.5. Repeated rows come back one row each, an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickloom.llm.common import byte_texts, pieces

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x7f-\xff]+")
SEED = 13
#: Different tokens whose hashes a task remembers.
REMEMBERED = 1 << 18
#: Bytes of one text whose tokens are listed at a time.
LISTED = 1 << 20
CAPITALS, BESIDE, AGAIN = (np.uint64(xxh64_intdigest(x, SEED)) for x in (b"\0capitals", b"\0beside", b"\0again"))
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Weights are averaged as integers of this fraction.
GRAIN = 1 << 32


@dataclass(frozen=True)
class Training:
    """The bounds of training and the learner's constants."""

    bits: int = 18
    sample: int = 16_384
    shard_rows: int = 4_096
    epochs: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1


class Hashes(dict):
    """Token to its hash; words in capitals get a marked hash (the lowest bit), others an even one."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        capitals = len(token) > 1 and token.isupper()
        made = xxh64_intdigest(token.lower(), SEED) & ~1 | capitals
        self[token] = made
        return made


def tokens(text: bytes, hashes: Hashes) -> np.ndarray:
    """The hashes of all tokens of one whole text."""
    parts, begin = [], 0
    while begin < len(text):
        end = begin + LISTED
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        found = TOKEN.findall(text[begin:end])
        parts.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
        begin = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(text: bytes, hashes: Hashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one whole text; the last bucket is the intercept."""
    marked = tokens(text, hashes)
    n = len(marked)
    last = np.array([(1 << bits) - 1])
    if not n:
        return last, np.ones(1)
    found = marked & ~np.uint64(1)
    pairs = mixed(found[:-1] * PAIR + found[1:])
    triples = mixed(pairs[:-1] * PAIR + found[2:])
    beside = np.zeros(n, bool)
    beside[1:] |= found[1:] == found[:-1]
    beside[2:] |= found[2:] == found[:-2]
    forms = [(CAPITALS, int((marked & np.uint64(1)).sum())), (BESIDE, int(beside.sum())), (AGAIN, len(triples) - len(np.unique(triples)))]
    extra = np.concatenate([np.full(k, h, np.uint64) for h, k in forms])
    buckets = (mixed(np.concatenate([found, pairs, extra])) % np.uint64((1 << bits) - 1)).astype(np.int64)
    buckets, counts = np.unique(buckets, return_counts=True)
    return np.append(buckets, last), np.append(np.sqrt(counts / n), 1.0)


def logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def follow(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Training) -> np.ndarray:
    """FTRL-proximal over the rows, in order, for some epochs: the weights."""
    z, n = np.zeros(1 << how.bits), np.zeros(1 << how.bits)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)
        return np.where(abs(z) <= how.l1, 0.0, w)

    for _ in range(how.epochs):
        for at, value, label in rows:
            w, seen = weights(z[at], n[at]), n[at]
            slope = (logistic(w @ value) - label) * value
            more = seen + slope * slope
            z[at] += slope - (np.sqrt(more) - np.sqrt(seen)) / how.alpha * w
            n[at] = more
    return weights(z, n)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, how: Training) -> DataFrame:
    """(doc_id, text, label, shard, turn) of the rows learned from."""
    told = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
    told = told.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    told = told.agg(F.min(F.coalesce("label", F.lit(-1))).alias("label"), F.max("label").alias("most"))
    told = told.where("label = most AND label IN (0, 1)").select("doc_id", "label", F.xxhash64("doc_id").alias("turn"))
    # Bounded by the sample, so one task may order it and every task may hold it.
    ids = F.broadcast(told.orderBy("turn", "doc_id").limit(how.sample))
    shards = max(1, -(-ids.count() // how.shard_rows))
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    one = rows.join(ids, "doc_id").groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))
    return one.select("doc_id", "text", "label", F.pmod("turn", F.lit(shards)).cast("int").alias("shard"), "turn")


def trained(rows: DataFrame, how: Training) -> np.ndarray:
    """The averaged weights of all shards of ``sample``."""

    def run(shard: pa.Table) -> pa.Table:
        hashes, order = Hashes(), np.argsort(shard["turn"].to_numpy(), kind="stable")
        made, labels = [], shard["label"].to_numpy()
        for batch in shard.select(["text"]).to_batches():
            made += [features(x, hashes, how.bits) for x in byte_texts(batch["text"])]
        w = np.rint(follow([(*made[i], labels[i]) for i in order], how) * GRAIN).astype(np.int64)
        at = np.flatnonzero(w)
        # Bucket -1 counts the shards.
        return pa.table({"bucket": np.append(at, -1), "weight": np.append(w[at], 1)})

    each = rows.groupBy("shard").applyInArrow(run, "bucket long, weight long")
    summed = each.groupBy("bucket").agg(F.sum("weight").alias("weight")).toArrow()
    bucket, weight = summed["bucket"].to_numpy(), summed["weight"].to_numpy()
    shards = weight[bucket < 0].sum()
    out = np.zeros(1 << how.bits)
    if shards:
        out[bucket[bucket >= 0]] = weight[bucket >= 0] / (GRAIN * float(shards))
    return out


def scored(docs: DataFrame, weights: np.ndarray, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    # 2**bits doubles, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    source = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = Hashes(), shared.value
        for batch in pieces(batches, "text"):
            sums = [float(w[at] @ value) for at, value in (features(x, hashes, bits) for x in byte_texts(batch["text"]))]
            made = pa.array(logistic(np.array(sums)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], made], names=["doc_id", "held_out", "score"])

    found = source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    how: Training = Training(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Learns from the labelled rows of ``docs`` and scores all of it."""
    weights = trained(sample(docs, labels, id_col, text_col, label_col, how), how)
    return scored(docs, weights, how.bits, id_col, text_col)
