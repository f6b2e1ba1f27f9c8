"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words ``[^\\x20\\x09-\\x0D]+``; lines of one set are one class. Two classes are
linked when their Jaccard similarity is at least 0.8. Words stand in one order, rarest first, so
similar sets must share a word of their prefixes: sets meet on prefix words, and pairs pass a length
filter, a positional filter and a bound from 128-bit parity maps before their real words are compared.
A word flips one bit of its set's map, so maps differ in no more bits than sets differ in words.

Many edited copies of one line all match, so their links are counted without a row for each. Up to
``HUBS`` hubs, the words that most of a family have, are found by their least word hashes, and a set near one
is known by its difference from the first such hub. With ``d`` words of a hub of ``n`` missing and ``i``
others added it weighs ``5 d + 4 i``; two sets of a hub whose differences share ``x`` words are linked when
their weights add up to ``n + 9 x`` at most. Pairs up to ``n`` are counted by weight; of the others only those
that share differing words meet, and their links are added up where they meet. Which hubs are found decides how many pairs are made, not which links.

A line is removed if an earlier line, by document id (null last), text hash and line number, has
its class or one linked to it. Every line but the first of its class goes, and all go if a linked
class begins earlier. Lines without words stay.

The order only has to be the same everywhere, so rarity is a count over all documents in a table of
2**20 buckets of word hashes, whose size does not depend on the data; words of one bucket are ordered
by hash. Word hashes decide which sets meet and how sets differ from hubs, and are 64 bits; the 128-bit name
of a set is half its map and the sum of its words' hashes. Pairs that do not share a hub are compared by the
words themselves.

A null text has one line without words. Rows of one id and one text are one document. An empty
table gives no rows. ``cleaned`` returns all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, byte_texts, pieces, stored

#: Similarity as a fraction.
PART, WHOLE = 4, 5
BUCKETS = 1 << 20
#: Buckets whose counts are added up together.
STRETCH = 1 << 8
#: Bits of the filter that picks lines whose words are needed.
FILTER_BITS = 1 << 24
#: Bytes worked on at a time, and sets a task remembers so as not to send them twice.
BLOCK, REMEMBERED = 1 << 20, 1 << 18
#: A prefix word of a set. Words are dealt out in slots, and a task packs so many records at a time by their slots.
ENTRY = np.dtype([*((c, np.int32) for c in ("word", "hub", "size", "at")), *((c, np.int64) for c in ("map", "map2", "sum"))])
SLOTS, PACKED = 1 << 13, 1 << 19
#: Sorted records a task gathers at least, pairs it looks at at a time, and sets of a hub with one differing word that meet in one group.
GATHERED, MET, TOGETHER = 1 << 17, 1 << 19, 1 << 12
#: Hubs at most, lines of the same least word hashes that make a family, and documents looked at for its hub.
HUBS, FAMILY, LOOKED = 1024, 48, 5
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn(k: int) -> np.int64:
    """Bits that put other hashes first, the last of them set."""
    return mixed(np.array([k + 1], np.uint64)).view(np.int64)[0] | np.int64(1)


class Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
        self.up = self.down = np.empty(0, np.uint64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(max(n, BLOCK + 1), base)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line number of every word of ``data``."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    np.logical_and((a - np.uint8(0x09)) > 4, a != 0x20, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    up, down = POWERS.grown(len(a) + 1)
    letters = POWERS.letters[a]
    letters *= up[: len(a)]
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(letters, out=sums[1:])
    sums = sums[edges]
    breaks = np.bincount(np.searchsorted(starts, np.flatnonzero(a == 10)), minlength=len(starts) + 1)
    lines = np.cumsum(breaks[: len(starts)], dtype=np.int32)
    return mixed((sums[1::2] - sums[::2]) * down[starts]), lines


def blocks(texts: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
    """Row numbers and joined text of some rows at a time."""
    rows: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if rows and held + len(text) > BLOCK:
            yield rows, b"\n".join(texts[r] for r in rows)
            rows, held = [], 0
        rows.append(i)
        held += len(text)
    if rows:
        yield rows, b"\n".join(texts[r] for r in rows)


def begins(lines: np.ndarray) -> np.ndarray:
    """Where each line begins in the ascending line numbers of words."""
    return np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1]))) if len(lines) else np.empty(0, np.int64)


def spans(low: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every number of the ranges of ``count`` from ``low``, with the range it is of, ``MET`` at most at a time."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, MET):
        stop = min(begin + MET, total)
        i, j = np.searchsorted(ends, (begin, stop - 1), "right")
        from_, some = low[i : j + 1].copy(), count[i : j + 1].copy()
        skipped = begin - (ends[i] - count[i])
        from_[0] += skipped
        some[0] -= skipped
        some[-1] -= ends[j] - stop
        yield np.repeat(np.arange(i, j + 1), some), np.arange(stop - begin) + np.repeat(from_ - (np.cumsum(some) - some), some)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], a_row: int = 1) -> Iterator[pa.Table]:
    """Rows sorted by ``keys``, each of about ``a_row`` records, some groups at a time, each whole."""
    held: list[pa.RecordBatch] = []
    least = GATHERED // a_row
    rows, wanted = 0, least
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table[k].to_numpy() for k in keys]
        others = np.flatnonzero(reduce(np.logical_or, (c != c[-1] for c in columns)))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows -= cut
        wanted = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def rows_of(texts: list[bytes], rows: list[int], line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``rows`` of every line of a block, and number of lines and first line of every row."""
    per_row = np.array([texts[r].count(b"\n") + 1 for r in rows])
    first = np.cumsum(per_row) - per_row
    return np.searchsorted(first, line, "right") - 1, per_row, first


def family_keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Three least word hashes of every line, each in an order of its own, as one negative number; bucket numbers are
    not negative. One word alone would often be a frequent one, which many lines share."""
    key = np.zeros(len(begin), np.uint64)
    for k in range(3 if len(begin) else 0):
        key = mixed(key + np.minimum.reduceat(hashes * turn(2 * k + 1).view(np.uint64) ^ turn(2 * k).view(np.uint64), begin))
    return -1 - (key >> np.uint64(1)).view(np.int64)


class Sets:
    """The distinct words of every line that has one, rarest first."""

    def __init__(self, data: bytes, levels: np.ndarray) -> None:
        self.arrange(*word_hashes(data), levels)

    def arrange(self, hashes: np.ndarray, lines: np.ndarray, levels: np.ndarray) -> None:
        rare = levels[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
        # line, rarity and as much of the hash as there is room for; words that are equal in these are compared by all of it
        room = np.uint64(56 - int(lines[-1]).bit_length() if len(lines) else 56)
        key = (lines.astype(np.uint64) << (room + np.uint64(8))) | (rare << room) | (hashes >> (np.uint64(64) - room))
        order = np.argsort(key)
        key, sorted_ = key[order], hashes[order]
        if np.any((key[1:] == key[:-1]) & (sorted_[1:] != sorted_[:-1])):
            order = np.lexsort((hashes, rare, lines))
        hashes, lines = hashes[order], lines[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (lines[1:] != lines[:-1])
        self.hashes, lines = hashes[new], lines[new]
        self.begin = begins(lines)
        self.line = lines[self.begin]
        self.size = np.diff(np.append(self.begin, len(lines)))
        if len(lines):
            bit = np.uint64(1) << (self.hashes >> np.uint64(58))
            half = (self.hashes >> np.uint64(57)) & np.uint64(1)
            self.maps = [np.bitwise_xor.reduceat(bit * (half == h), self.begin).view(np.int64) for h in (0, 1)]
            self.sum = np.add.reduceat(mixed(self.hashes + BASE), self.begin).view(np.int64)
        else:
            self.maps, self.sum = [np.empty(0, np.int64)] * 2, np.empty(0, np.int64)

    def prefixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the prefix words of the chosen sets: number of the set, hash of the word, position."""
        length = self.size - (PART * self.size + WHOLE - 1) // WHOLE + 1
        length = length[chosen]
        which = np.repeat(chosen, length)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return which, self.hashes[self.begin[which] + at], at

    def words(self, i: int) -> np.ndarray:
        return self.hashes[self.begin[i] : self.begin[i] + self.size[i]]


class Hubs:
    """Sets that families lie around, the largest family first."""

    def __init__(self, hubs: list[np.ndarray], levels: np.ndarray) -> None:
        self.hubs, self.size = hubs, np.array([len(h) for h in hubs], np.int64)
        found = [Sets.__new__(Sets) for _ in hubs]
        for sets, words in zip(found, hubs, strict=True):
            sets.arrange(words, np.zeros(len(words), np.int32), levels)
        self.maps = [np.array([x.maps[h][0] for x in found], np.int64) for h in (0, 1)]
        prefixes = [x.prefixes(np.array([0]))[1] for x in found]
        words = np.concatenate([*prefixes, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(hubs)), [len(p) for p in prefixes])
        order = np.argsort(words, kind="stable")
        self.words, self.owner = words[order], owner[order]
        self.known = np.zeros(BUCKETS, bool)
        self.known[(self.words & np.uint64(BUCKETS - 1)).view(np.int64)] = True

    def nearest(self, sets: Sets, which: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Number of the first hub near each set, from 1; 0 where none is."""
        out = np.full(len(sets.size), len(self.hubs) + 1)
        some = self.known[(words & np.uint64(BUCKETS - 1)).view(np.int64)]
        which, words = which[some], words[some]
        low, high = np.searchsorted(self.words, words, "left"), np.searchsorted(self.words, words, "right")
        count = high - low
        which = np.repeat(which, count)
        hub = self.owner[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        size, others = sets.size[which], self.size[hub]
        some = (size * WHOLE >= others * PART) & (others * WHOLE >= size * PART)
        which, hub, both = which[some], hub[some], (size + others)[some]
        apart = sum(np.bitwise_count((a[which] ^ b[hub]).view(np.uint64)).astype(np.int64) for a, b in zip(sets.maps, self.maps, strict=True))
        near = apart <= both - 2 * ((PART * both + PART + WHOLE - 1) // (PART + WHOLE))
        np.minimum.at(out, which[near], hub[near] + 1)
        return np.where(out > len(self.hubs), 0, out)

    def difference(self, hub: int, words: np.ndarray) -> tuple[int, np.ndarray]:
        """Weight of a set of a hub, and the words of only one of the two."""
        base = self.hubs[hub - 1]
        differ = np.setxor1d(base, words, assume_unique=True)
        added = (len(differ) + len(words) - len(base)) // 2
        return WHOLE * (len(differ) - added) + PART * added, differ.view(np.int64)


def survey(docs: DataFrame) -> tuple[np.ndarray, Hubs]:
    """Level of every bucket, eight times the logarithm of its words over all documents, and the hubs."""
    looks = [f"hash{k}" for k in range(LOOKED)]
    names = ["key", "count", *looks, "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, "text"):
            texts, keys, sums, owners = byte_texts(batch["text"]), [], [], []
            for rows, data in blocks(texts):
                hashes, lines = word_hashes(data)
                counts += np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                begin = begins(lines)
                if len(begin):
                    keys.append(family_keys(hashes, begin))
                    sums.append(np.add.reduceat(mixed(hashes + BASE), begin))
                    owners.append(rows_of(texts, rows, lines[begin])[0] + rows[0])
            if keys:
                key, total, owner = np.concatenate(keys), np.concatenate(sums), np.concatenate(owners)
                order = np.lexsort((total, key))
                key, total, owner = key[order], total[order], owner[order]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (total[1:] != total[:-1])))
                key, owner = key[new], owner[new]
                begin = begins(key)
                hashes = batch["hash"].to_numpy()[owner]
                seen = [np.minimum.reduceat(hashes ^ turn(k), begin) for k in range(LOOKED)]
                columns = [key[begin], np.diff(np.append(begin, len(key))), *seen]
                none = pa.nulls(len(begin), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), none], names=names)
        stretches = counts.reshape(-1, STRETCH)
        held = np.flatnonzero(stretches.any(axis=1))
        empty = pa.nulls(len(held), pa.int64())
        packed = pa.array([x.tobytes() for x in stretches[held]], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(held), *[empty] * (1 + LOOKED), packed], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, packed in zip(batch["key"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[key] = sums.get(key, 0) + np.frombuffer(packed, np.int64)
        for key, counts in sums.items():
            level = np.where(counts, np.minimum(255, np.floor(np.log2(np.maximum(counts, 1)) * 8) + 1), 0).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"key": pa.array([key]), "levels": pa.array([level.tobytes()], pa.binary())})

    found = docs.select("hash", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", counts binary")
    found = stored(found, "line-words")
    levels = np.zeros((BUCKETS // STRETCH, STRETCH), np.uint8)
    table = found.where("key >= 0").select("key", "counts").repartition("key").mapInArrow(summed, "key long, levels binary").toArrow()
    for key, level in zip(table["key"].to_pylist(), table["levels"].to_pylist(), strict=True):
        levels[key] = np.frombuffer(level, np.uint8)
    levels = levels.ravel()
    families = found.where("key < 0").groupBy("key").agg(F.sum("count").alias("count"), *[F.min(c).alias(c) for c in looks])
    families = families.where(F.col("count") >= FAMILY).orderBy(F.desc("count"), "key").limit(HUBS).collect()
    return levels, Hubs(_hubs(docs, families), levels)


def _hubs(docs: DataFrame, families: list[Row]) -> list[np.ndarray]:
    """Of each family, the words that most of its lines in the documents looked at have."""
    if not families:
        return []
    looked = {r[f"hash{k}"] ^ int(turn(k)) for r in families for k in range(LOOKED)}
    wanted = np.sort(np.array([r["key"] for r in families]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for _, data in blocks(byte_texts(batch["text"])):
                hashes, lines = word_hashes(data)
                begin = begins(lines)
                keys = family_keys(hashes, begin)
                stop = np.append(begin, len(lines))
                met = np.flatnonzero(np.isin(keys, wanted))
                lists = [np.unique(hashes[stop[i] : stop[i + 1]]).tobytes() for i in met.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys[met], pa.int64()), pa.array(lists, pa.binary())], names=["key", "words"])

    lines = docs.where(F.col("hash").isin(looked)).select("text").mapInArrow(run, "key long, words binary").distinct()
    # at most LOOKED lines a family
    kept = lines.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("words"), "words"))).where(F.col("n") <= LOOKED)
    found: dict[int, list[np.ndarray]] = {}
    for r in kept.collect():
        found.setdefault(r["key"], []).append(np.frombuffer(r["words"], np.uint64))
    out = []
    for r in families:
        words, counts = np.unique(np.concatenate(found.get(r["key"], [np.empty(0, np.uint64)])), return_counts=True)
        words = words[2 * counts > len(found.get(r["key"], []))]
        if len(words):
            out.append(words)
    return out


def entries(docs: DataFrame, levels: np.ndarray, hubs: Hubs) -> DataFrame:
    """Prefix words of all sets as ``ENTRY`` records, those of one slot of words together."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, hubs))

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        slot = rows["word"] & (SLOTS - 1)
        order = np.argsort(slot, kind="stable")
        slots, begin = np.unique(slot[order], return_index=True)
        ends = np.append(begin, len(rows)).astype(np.int32) * ENTRY.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(slots), [None, pa.py_buffer(ends), pa.py_buffer(rows[order].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), data], names=["slot", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, hubs = shared.value
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        for batch in pieces(batches, "text"):
            for _, data in blocks(byte_texts(batch["text"])):
                sets = Sets(data, levels)
                if len(seen) > REMEMBERED:
                    seen = set()
                names = (sets.sum ^ sets.maps[0]).tolist()
                fresh = [i for i, x in enumerate(names) if not (x in seen or seen.add(x))]
                which, words, at = sets.prefixes(np.array(fresh, np.int64))
                rows = np.empty(len(which), ENTRY)
                rows["word"] = (words >> np.uint64(16)).astype(np.uint32).view(np.int32)
                rows["hub"], rows["size"], rows["at"] = hubs.nearest(sets, which, words)[which], sets.size[which], at
                rows["map"], rows["map2"], rows["sum"] = sets.maps[0][which], sets.maps[1][which], sets.sum[which]
                parts.append(rows)
                if sum(map(len, parts)) >= PACKED:
                    yield packed(parts)
                    parts = []
        if parts:
            yield packed(parts)

    return docs.select("text").mapInArrow(run, "slot int, rows binary")


def candidates(found: DataFrame) -> DataFrame:
    """Pairs of sets without a common hub that the filters leave, by their sums.

    The smaller set of a pair needs a shorter prefix, as its partners have at least its size. A similar pair passes at
    the first word that both have, where all common words are still to come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["slot"], PACKED // SLOTS):
            rows = np.frombuffer(b"".join(table["rows"].to_pylist()), ENTRY)
            rows = rows[np.lexsort((rows["sum"], (rows["word"].astype(np.int64) << 32) + rows["size"]))]
            columns = [np.ascontiguousarray(rows[c]) for c in ENTRY.names]
            new = np.ones(len(rows), bool)
            new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
            word, hub, size, at, *maps, total = (c[new] for c in columns)
            size, after = size.astype(np.int64), size.astype(np.int64) - at
            place = (np.cumsum(np.diff(word, prepend=word[:1]) != 0) << 32) + size
            # the words still to come of either are (PART * both) / (PART + WHOLE) at least
            largest = after * (PART + WHOLE) // PART - size
            first = np.flatnonzero(largest >= size)
            last = np.searchsorted(place, place[first] - size[first] + largest[first], "right")
            asked, given = PART * size[first], after * (PART + WHOLE) - PART * size
            for which, b in spans(first + 1, last - first - 1):
                some = given[b] >= asked[which]
                a, b = first[which[some]], b[some]
                some = (hub[a] != hub[b]) | (hub[a] == 0)
                a, b = a[some], b[some]
                both = size[a] + size[b]
                spare = both - 2 * ((PART * both + PART + WHOLE - 1) // (PART + WHOLE))
                apart = sum(np.bitwise_count((m[a] ^ m[b]).view(np.uint64)).astype(np.int64) for m in maps)
                some = (apart <= spare) & ((total[a] != total[b]) | (maps[0][a] != maps[0][b]))
                yield pa.RecordBatch.from_arrays([pa.array(total[x[some]]) for x in (a, b)], names=["sum_a", "sum_b"])

    dealt = found.repartition("slot").sortWithinPartitions("slot")
    return dealt.mapInArrow(run, "sum_a long, sum_b long").distinct()


def _needed(pairs: DataFrame) -> bytes:
    """A filter of fixed size that has the sums of all sets in pairs."""
    # bitmaps number their buckets and bits from the value 1 on
    slot = (F.pmod(F.col("sum"), F.lit(FILTER_BITS)) + 1).cast("long")
    ends = pairs.select(F.explode(F.array("sum_a", "sum_b")).alias("sum")).select(slot.alias("slot"))
    maps = ends.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    rows = {r["k"]: bytes(r["bits"]) for r in maps.collect()}
    width = 4096
    return b"".join(rows.get(k, bytes(width)).ljust(width, b"\0") for k in range(1, FILTER_BITS // (8 * width) + 1))


def occurrences(docs: DataFrame, levels: np.ndarray, hubs: Hubs, needed: bytes) -> DataFrame:
    """Per line with words: doc_id, hash, line, map, sum, its text if the filter has it, and if it has a hub that, its
    weight and the differing words; per row one of line -1."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, hubs, needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, hubs, needed = shared.value
        bits = np.unpackbits(np.frombuffer(needed, np.uint8), bitorder="little")
        for batch in pieces(batches, "text"):
            texts = byte_texts(batch["text"])
            for rows, data in blocks(texts):
                sets = Sets(data, levels)
                lines = data.split(b"\n")
                row, per_row, first = rows_of(texts, rows, sets.line)
                wanted = bits[np.mod(sets.sum, FILTER_BITS)]
                said = [lines[i].decode() if w else None for i, w in zip(sets.line.tolist(), wanted.tolist(), strict=True)]
                hub = hubs.nearest(sets, *sets.prefixes(np.arange(len(sets.size)))[:2])
                differ = [hubs.difference(h, sets.words(i)) if h else (None, None) for i, h in enumerate(hub.tolist())]
                none = [None] * len(rows)
                source = pa.array(np.concatenate((row, np.arange(len(rows)))) + rows[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(source),
                        batch["hash"].take(source),
                        pa.array(np.concatenate((sets.line - first[row], np.full(len(rows), -1))), pa.int32()),
                        pa.array([*sets.maps[0].tolist(), *none], pa.int64()),
                        pa.array([*sets.sum.tolist(), *per_row.tolist()], pa.int64()),
                        pa.array([*said, *none], pa.string()),
                        pa.array([*(h or None for h in hub.tolist()), *none], pa.int32()),
                        pa.array([*(w for w, _ in differ), *none], pa.int64()),
                        pa.array([*(d for _, d in differ), *none], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "hash", "line", "map", "sum", "text", "hub", "weight", "differ"],
                )

    return docs.mapInArrow(run, "doc_id long, hash long, line int, map long, sum long, text string, hub int, weight long, differ array<long>")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, SPACES), lambda x: x != ""))


def links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose words are similar enough, both ways: map, sum, n_links, other_first."""
    for end in ("a", "b"):
        side = classes.select(
            F.col("map").alias(f"map_{end}"), F.col("sum").alias(f"sum_{end}"),
            F.col("text").alias(f"text_{end}"), F.col("first").alias(f"first_{end}"),
        )
        pairs = pairs.join(side, f"sum_{end}")
    pairs = pairs.where("map_a <> map_b OR sum_a <> sum_b")
    a, b = words_of(F.col("text_a")), words_of(F.col("text_b"))
    pairs = pairs.withColumn("a", a).withColumn("b", b)
    alike = F.size(F.array_intersect("a", "b")) * (PART + WHOLE) >= (F.size("a") + F.size("b")) * PART
    ends = [
        F.struct(F.col(f"map_{x}").alias("map"), F.col(f"sum_{x}").alias("sum"), F.lit(1).cast("long").alias("n_links"), F.col(f"first_{y}").alias("other_first"))
        for x, y in ("ab", "ba")
    ]
    return pairs.where(alike).select(F.explode(F.array(*ends)).alias("x")).select("x.*")


def family_links(classes: DataFrame, hubs: Hubs) -> DataFrame:
    """Links of sets that share a hub: map, sum, n_links, other_first (here the set's own first may be counted in)."""
    spark = classes.sparkSession
    sizes = spark.createDataFrame([(i + 1, int(n)) for i, n in enumerate(hubs.size)], "hub int, n long")
    members = classes.where("hub IS NOT NULL").join(sizes, "hub")
    weights = members.groupBy("hub", "n", "weight").agg(F.count(F.lit(1)).alias("sets"), F.min("first").alias("first"))
    others = weights.select("hub", F.col("weight").alias("other"), "sets", "first")
    reached = weights.select("hub", "n", "weight").join(others, "hub").where("weight + other <= n").groupBy("hub", "weight")
    reached = reached.agg(F.sum("sets").alias("n_links"), F.min("first").alias("other_first"))
    own = F.when(F.col("weight") * 2 <= F.col("n"), 1).otherwise(0)
    plain = members.join(reached, ["hub", "weight"]).select("map", "sum", (F.col("n_links") - own).alias("n_links"), "other_first")
    # a pair beyond n shares differing words and meets on the first of them
    word = members.select("hub", "n", "map", "sum", "first", "weight", "differ", F.explode("differ").alias("word"))
    held = word.groupBy("hub", "word").agg(F.count(F.lit(1)).alias("held"), F.max("weight").alias("top"))
    met = word.join(held.where("held > 1"), ["hub", "word"]).where("weight + top > n")
    # sets of a frequent word are dealt into parts, and every two parts meet in a group of their own
    met = met.withColumn("parts", F.ceil(F.col("held") / TOGETHER)).withColumn("part", F.pmod(F.xxhash64("map", "sum"), "parts"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("held", "top", "parts", "other")
    keys = ["hub", "word", "low", "high"]
    kind = classes.schema["first"].dataType.simpleString()
    sums = met.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(_beyond, f"map long, sum long, n_links long, other_first {kind}")
    return plain.unionByName(sums)


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links beyond n of every set in groups by hub, word and two parts: map, sum, n_links, other_first."""
    keys = ["hub", "word", "low", "high"]
    for rows in whole_groups(batches, keys):
        columns = [rows[k].to_numpy() for k in keys]
        word, low, high = columns[1:]
        weight, n, part = (rows[c].to_numpy() for c in ("weight", "n", "part"))
        differ = rows["differ"].combine_chunks()
        length = differ.value_lengths().to_numpy().astype(np.int64)
        begin = np.cumsum(length) - length
        words, code = np.unique(differ.flatten().to_numpy(), return_inverse=True)
        known = np.repeat(np.arange(len(length)), length) * len(words) + code
        known.sort()
        new = np.ones(len(word), bool)
        new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
        starts = np.flatnonzero(new)
        stop = np.append(starts[1:], len(word))[np.cumsum(new) - 1]
        count, least = np.zeros(len(word), np.int64), np.full(len(word), len(word))
        at = np.arange(len(word))
        for a, b in spans(at + 1, stop - at - 1):
            beyond = weight[a] + weight[b] - n[a]
            some = (beyond > 0) & (beyond <= np.minimum(length[a], length[b]) * (PART + WHOLE)) & ((part[a] != part[b]) | (low[a] == high[a]))
            a, b, beyond = a[some], b[some], beyond[some]
            common, earlier = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            for pair, k in spans(begin[a], length[a]):
                wanted = b[pair] * len(words) + code[k]
                found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                pair, k = pair[known[found] == wanted], k[known[found] == wanted]
                common += np.bincount(pair, minlength=len(a))
                earlier += np.bincount(pair[words[code[k]] < word[a[pair]]], minlength=len(a))
            linked = (earlier == 0) & (beyond <= common * (PART + WHOLE))
            for x, y in ((a[linked], b[linked]), (b[linked], a[linked])):
                count += np.bincount(x, minlength=len(count))
                np.minimum.at(least, x, y)
        has = np.flatnonzero(count)
        # rows of a group come by their firsts
        first = rows["first"].combine_chunks().take(pa.array(least[has]))
        names = ["map", "sum", "n_links", "other_first"]
        yield pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(pa.array(has)) for c in names[:2]), pa.array(count[has]), first], names=names)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, hash (of its text), n_lines, n_removed, n_links, removed (line numbers)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    levels, hubs = survey(source)
    pairs = stored(candidates(entries(source, levels, hubs)), "line-pairs")
    found = stored(occurrences(source, levels, hubs, _needed(pairs)), "lines")
    place = F.struct("no_id", "doc_id", "hash", "line")
    named = found.where("line >= 0").withColumn("no_id", F.col("doc_id").isNull())
    worded = named.where("text IS NOT NULL OR hub IS NOT NULL").groupBy("map", "sum")
    alike = [F.any_value(c).alias(c) for c in ("hub", "weight", "differ")]
    worded = stored(worded.agg(F.min("text").alias("text"), F.min(place).alias("first"), *alike), "line-classes")
    linked = links(pairs, worded.where("text IS NOT NULL"))
    if hubs.hubs:
        linked = linked.unionByName(family_links(worded, hubs))
    linked = linked.groupBy("map", "sum").agg(F.sum("n_links").alias("n_links"), F.min("other_first").alias("other"))
    lines = named.select("no_id", "doc_id", "hash", "line", "map", "sum").repartition("map", "sum")
    classes = lines.groupBy("map", "sum").agg(F.min(place).alias("first")).join(linked, ["map", "sum"], "left")
    keep_first = F.col("other").isNull() | (F.col("first") <= F.col("other"))
    classes = classes.select("map", "sum", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), keep_first.alias("stays"))
    judged = lines.join(classes, ["map", "sum"])
    gone = ~(F.col("stays") & (place == F.col("first")))
    judged = judged.select("doc_id", "hash", "line", "n_links", gone.alias("gone"), F.lit(None).cast("long").alias("n_lines"))
    per_row = found.where("line = -1").select(
        "doc_id", "hash", F.col("line"), F.lit(0).cast("long").alias("n_links"), F.lit(False).alias("gone"), F.col("sum").alias("n_lines")
    )
    each = judged.unionByName(per_row).repartition("doc_id", "hash").distinct()
    return each.groupBy("doc_id", "hash").agg(
        F.max("n_lines").alias("n_lines"),
        F.count_if("gone").alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their texts freed of removed lines; null stays null."""
    gone = decisions(docs, id_col, text_col).where("n_removed > 0")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "removed")
    text = docs[text_col].cast("string")
    rows = docs.select(F.struct("*").alias("__row"), docs[id_col].alias("__doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__key"))
    met = rows.join(gone, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")
    old = F.col("__row")[text_col]
    left = F.filter(F.split(old, "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    new = F.when(F.col("removed").isNull(), old).otherwise(F.array_join(left, "\n"))
    return met.select([new.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
