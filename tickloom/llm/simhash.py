"""Near duplicates by SimHash fingerprints and multi-index hashing.

A text is lower-cased (A-Z only) and cut into words ``[^\\x20\\x09-\\x0D]+``. Its features are its
shingles of some words, repeats included, joined by one space; a text of fewer words is one
feature, and a text without words, null included, has fingerprint zero. A feature's hash is XXH64
with seed 42; a bit of the fingerprint is 1 if set in more than half of the hashes. Longer
fingerprints have further 64-bit words, made from the same hash.

``Index``: fingerprints of one word that differ in at most ``distance`` bits are linked. The word is
cut into segments; a fingerprint looks up, in each segment's table, the values within ``radius``
bits of its own, and checks the whole distance of what it meets. Linked pairs that differ by at most
``(radius + 1) * segments - 1`` bits agree that well in some segment and are always met.

``Similar``: texts are linked whose sets of shingles have at least the Jaccard ``similarity``, compared
exactly but for collisions of 64-bit hashes. Longer fingerprints are cut into segments, in as many
orders of their bits as it takes; a fingerprint looks up the values within one bit of its own in each
segment's table. Segments are ``spare`` bits wider than the number of fingerprints needs, so that the
chance meetings of one fingerprint stay the same few however many there are, and as many as give the
``recall`` at that width. What is met has its whole distance checked, and what is within ``distance`` its
sets. Pairs that other links join already are not compared: that leaves the components as they are, so
rounds first compare each text with one hub of the tables' entries it meets, and then all pairs still
apart that meet. Hubs are the texts that meet most others: of copies with edits of their own those
with the fewest, to which most others are similar. Of texts that meet many, the last round counts the
shingles that some text of another component has; a pair shares no more than the lesser count, and
pairs that would need more are left out.

Only different fingerprints are looked up: equal ones are one node, however many documents have it.

Rows with null ids, repeated rows and ties are judged like any other, one row each; an empty table
gives no rows. ``one_of_each`` returns all columns of the rows it keeps, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tickloom.llm.common import Scratch, byte_texts, pieces, stored
from tickloom.llm.components import components

BITS, SEED = 64, 42
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16
STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Index:
    """How one-word fingerprints are made and looked up, with ``per_word`` segments."""

    shingle: int = 5
    words: int = 1
    per_word: int = 3
    radius: int = 1
    distance: int = 3


@dataclass(frozen=True)
class Similar:
    """How longer fingerprints are made, looked up and compared."""

    shingle: int = 5
    words: int = 12
    spare: int = 6
    recall: float = 0.97
    distance: int = 146
    similarity: float = 0.8
    #: Rounds that compare a node with one hub.
    hubs: int = 2
    #: Nodes whose looked-up values hold so many entries have their shared shingles counted before the last round.
    crowd: int = 64

    def segments(self, nodes: int) -> np.ndarray:
        """The bits of every segment for so many fingerprints, one segment a row.

        Sets of Jaccard similarity s and equal size make prints that differ in each bit with probability
        acos(2 s / (1 + s)) / pi; a segment meets if none of its bits differ, or one.
        """
        width = max(12, ceil(log2(max(nodes, 1))) + self.spare)
        same = 1 - acos(2 * self.similarity / (1 + self.similarity)) / pi
        meets = same**width + width * (1 - same) * same ** (width - 1)
        wanted = ceil(log(1 - self.recall) / log(1 - meets))
        rng, n = np.random.RandomState(SEED), self.words * BITS
        each = n // width
        rows = [rng.permutation(n)[: each * width].reshape(each, width) for _ in range(-(-wanted // each))]
        return np.concatenate(rows)[:wanted]


#: A pair at 0.8 differs in 116 of 768 bits on average, with a spread of 10; the segments meet 97 % of such pairs.
SIMILAR = Similar()
#: 64 bits of three-word shingles and links up to 3 bits, all of which are met.
CLOSE = Index(shingle=3, words=1, per_word=2, radius=1, distance=3)


def further(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th word's hashes from the first's."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * STEP % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different hashes of the shingles of one whole text, as signed numbers."""
    found = text.lower().split()
    joined, stops = b" ".join(found), np.cumsum([len(x) + 1 for x in found], dtype=np.int64) - 1
    starts, last = np.concatenate(([0], stops[:-1] + 1)), min(shingle, len(found)) - 1
    spans = zip(starts[: len(found) - last].tolist(), stops[last:].tolist()) if found else ()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")).view("<i8")


def fingerprint(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """The words of the fingerprint of one whole text, as signed numbers."""
    found = text.lower().split()
    if not found:
        return [0] * words
    joined = b" ".join(found)
    stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    shingle = min(shingle, len(found))
    n = len(found) - shingle + 1
    counts = np.zeros(words * BITS, np.int64)
    for i in range(0, n, COUNTED):
        spans = zip(starts[i : min(i + COUNTED, n)].tolist(), stops[i + shingle - 1 : i + shingle - 1 + COUNTED].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        for k in range(words):
            bits = np.unpackbits(further(hashes, k).view(np.uint8), bitorder="little").reshape(-1, BITS)
            counts[k * BITS : (k + 1) * BITS] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<i8").tolist()


def fingerprints(df: DataFrame, text_col: str, index: Index | Similar) -> DataFrame:
    """All columns of ``df`` but the text, then ``print``: the fingerprint's words."""
    rest = [c for c in df.columns if c != text_col]
    source = df.select(*[df[f"`{c}`"] for c in rest], df[text_col].cast("string").alias("__text"))
    schema = T.StructType([*source.schema[:-1], T.StructField("print", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            prints = [fingerprint(x, index.shingle, index.words) for x in byte_texts(batch["__text"])]
            made = pa.array(prints, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], made], names=schema.names)

    return source.mapInArrow(run, schema)


def links(prints: DataFrame, index: Index) -> DataFrame:
    """Pairs (a, b) of nodes of ``prints`` (node, print) that the index links, a < b.

    With radius 1 only the side that has a zero where the two differ looks the other up.
    """
    cuts = [BITS * k // index.per_word for k in range(index.per_word + 1)]
    segments = [(word, low, high - low) for word in range(index.words) for low, high in zip(cuts, cuts[1:])]
    width = max(w for _, _, w in segments)
    flips = [sum(1 << i for i in c) for r in range(index.radius + 1) for c in combinations(range(width), r)]

    def part(word: int, low: int, size: int) -> Column:
        mask = F.lit((1 << size) - 1).cast("long")
        return F.shiftrightunsigned(F.element_at("print", word + 1), low).bitwiseAND(mask)

    own = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.lit(s[2]).alias("width"), part(*s).alias("key"))
                for k, s in enumerate(segments)
            ]
        )
    )
    nodes = prints.select("node", own.alias("s"))
    tables = nodes.select(F.col("node").alias("b"), "s.k", "s.key")
    ball = F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip")
    probes = nodes.select(F.col("node").alias("a"), "s.*", ball).where(F.col("flip") < F.expr("shiftleft(1L, width)"))
    if index.radius == 1:
        probes = probes.where(F.col("key").bitwiseAND(F.col("flip")) == 0)
    probes = probes.select("a", "k", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    # Spark sizes the exploded rows like the nodes they come from, far too low for a broadcast.
    met = probes.hint("merge").join(tables, ["k", "key"]).where("a <> b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= index.distance
    return met.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def looked_up(nodes: DataFrame, segments: np.ndarray, radius: int) -> DataFrame:
    """(key, node) of ``nodes`` (node, print): each segment's own value and, with radius 1, those with one more bit.

    Where two values differ in one bit, the one that has a zero there finds the other.
    """
    count, width = segments.shape
    powers, numbers = np.int64(1) << np.arange(width), np.arange(count, dtype=np.int64) << width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                words = np.array(part["print"].flatten(), "<i8").view(np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(words, axis=1, bitorder="little")[:, segments]
                own, names = bits @ powers + numbers, part["node"].to_numpy()
                keys, ids = [own.ravel()], [np.repeat(names, count)]
                if radius:
                    row, segment, bit = np.nonzero(bits == 0)
                    keys.append(own[row, segment] + powers[bit])
                    ids.append(names[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids)], names=["key", "node"])

    return nodes.select("node", "print").mapInArrow(run, "key long, node long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, index: Similar) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the text of each node's first row."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    first = nodes.join(wanted, "node", "left_semi").select("node", "first")
    same = F.col("id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.text_hash"))
    texts = first.join(rows, same).select("node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            made = pa.array([shingle_set(x, index.shingle) for x in byte_texts(batch["text"])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["node"], made], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _rooms(
    docs: DataFrame, nodes: DataFrame, roots: DataFrame, wanted: DataFrame, id_col: str, text_col: str, index: Similar, work: Scratch
) -> DataFrame:
    """Of the wanted nodes: node, size (of its set), room (shingles of it that wanted nodes of another root have)."""
    sets = work.stored(_sets(docs, nodes, wanted, id_col, text_col, index), "crowded")
    each = sets.join(roots, "node").select("node", "root", F.explode("shingles").alias("shingle"))
    across = each.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    room = each.join(across, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("room"))
    return sets.join(room, "node", "left").select("node", F.size("shingles").alias("size"), F.coalesce("room", F.lit(0)).alias("room"))


def similar(
    docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, index: Similar, work: Scratch
) -> DataFrame:
    """The ``pairs`` (a, b) whose texts are as similar as asked."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("print").alias(f"print_{end}")), end)
    near = work.stored(pairs.where(_apart("print_a", "print_b", index) <= index.distance).select("a", "b"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = work.stored(_sets(docs, nodes, wanted, id_col, text_col, index), "shingles")
    for end in ("a", "b"):
        near = near.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return work.stored(near.where(both >= index.similarity * either).select("a", "b"), "similar")


def _apart(a: str, b: str, index: Similar) -> Column:
    return sum(F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(index.words))


def similar_groups(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, index: Similar) -> DataFrame:
    """(node, root) of every one of ``nodes`` (node, print, first), linked by similarity."""
    work, segments = Scratch(nodes.sparkSession), index.segments(nodes.count())
    held = looked_up(nodes, segments, 0)
    others = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("one"))
    # Spark sizes what is looked up like the nodes, hundreds of times too low for a broadcast.
    asks = looked_up(nodes, segments, 1).hint("merge").join(others, "key").where("n > 1 OR one <> node").select("key", "node", "n")
    asks = work.stored(asks, "asks")
    held = work.stored(held.join(asks.select("key").distinct(), "key", "left_semi"), "held")
    scores = work.stored(asks.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    ranked = nodes.join(scores, "node", "left").select("node", F.coalesce("score", F.lit(0)).alias("score"))
    roots, links = ranked.select("node", F.col("node").alias("root"), "score"), None
    for turn in range(index.hubs + 1):
        members = held.join(roots, "node")
        hub = F.max(F.struct("score", "node", "root")).alias("hub")
        keys = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), hub)
        apart = asks.select("key", "node").join(roots, "node").join(keys, "key").where("least <> root OR most <> root")
        if turn < index.hubs:
            pairs = apart.where("root <> hub.root").groupBy("node", F.col("hub.node").alias("b"), "hub.score")
            pairs = pairs.agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("node").alias("a"))
            # first the hub met in most tables, then the one that meets most: a family gathers about few
            best = F.struct("score", "n", "b") if turn % 2 else F.struct("n", "score", "b")
            pairs = pairs.agg(F.max_by("b", best).alias("b"))
        else:
            apart = work.stored(apart.select("key", "node", "root", "score"), "apart")
            open_members = members.join(apart.select("key").distinct(), "key", "left_semi")
            crowded = [x.where(F.col("score") >= index.crowd).select("node") for x in (apart, open_members)]
            rooms = work.stored(_rooms(docs, nodes, roots, crowded[0].unionByName(crowded[1]).distinct(), id_col, text_col, index, work), "rooms")
            known = nodes.select("node", "print").join(rooms, "node", "left")
            one, two = (
                x.join(known, "node").select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "print", "size", "room")])
                for k, x in (("a", apart), ("b", open_members))
            )
            met = one.join(two, "key").where(F.col("root_a") != F.col("root_b"))
            met = met.where(_apart("print_a", "print_b", index) <= index.distance)
            enough = F.least("room_a", "room_b") * (1 + index.similarity) >= (F.col("size_a") + F.col("size_b")) * index.similarity - 1e-6
            met = met.where(F.col("room_a").isNull() | F.col("room_b").isNull() | enough)
            pairs = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        found = similar(docs, nodes, pairs, id_col, text_col, index, work)
        links = found if links is None else links.unionByName(found)
        placed = stored(components(links).withColumnRenamed("node", "linked"), "roots")
        roots = ranked.join(placed, ranked["node"] == placed["linked"], "left").select("node", F.coalesce("root", "node").alias("root"), "score")
    work.drop()
    return nodes.join(placed, nodes["node"] == placed["linked"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _prints(docs: DataFrame, id_col: str, text_col: str, index: Index | Similar) -> DataFrame:
    """Stored per row: doc_id, text_hash (tells rows of one id apart), print, node (its short name)."""
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return stored(fingerprints(source, "text", index), "doc-prints")


def grouped(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, index: Index | Similar) -> DataFrame:
    """Per fingerprint of ``_prints``: print, and first: the least row of its component."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    name = F.monotonically_increasing_id() if isinstance(index, Similar) else F.element_at("print", 1)
    nodes = stored(prints.groupBy("print").agg(F.min(row).alias("first")).withColumn("node", name), "prints")
    if isinstance(index, Similar):
        roots = similar_groups(docs, nodes, id_col, text_col, index)
    else:
        roots = components(links(nodes.select("node", "print"), index))
    roots = roots.withColumnRenamed("node", "linked")
    placed = nodes.join(roots, F.col("node") == F.col("linked"), "left").select(
        "print", "first", F.coalesce("root", "node").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.select("print", "root").join(least, "root").select("print", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | Similar = SIMILAR) -> DataFrame:
    """Per row: doc_id, fingerprint (hex digits), component_id, the least id reachable by links."""
    prints = _prints(docs, id_col, text_col, index)
    # Of copies the prints take next to no room in files, by which Spark would size a broadcast.
    found = prints.hint("merge").join(grouped(docs, prints, id_col, text_col, index), "print")
    digits = F.array_join(F.transform("print", lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return found.select("doc_id", digits.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | Similar = SIMILAR) -> DataFrame:
    """The row of the least id of every component, with all its columns; one of repeated rows."""
    prints = _prints(docs, id_col, text_col, index)
    keep = grouped(docs, prints, id_col, text_col, index).select("first.*").distinct()
    keep = keep.select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"))
    rows = docs.select(
        F.struct("*").alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("hash")
    )
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash"))
    chosen = rows.join(keep, same, "left_semi")
    one = chosen.groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")
