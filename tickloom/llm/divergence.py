"""How far the sources of one language lie apart, by row accumulation over a term-major index.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language
keeps the terms that occur in at least ``least_docs`` of its documents. A (lang, source) group, and
a language, gives each kept term the share p = 1 + floor(unit * (count + pad) / (N + pad * V)),
N the group's count over the V kept terms.

The distance of two groups is the sum of abs(p - q) over all kept terms, most of which most groups
lack. With b the share of a count of zero, a group g and a peer h are apart by

    V * abs(b_g - b_h)                                          neither has the term
    + sum over the terms of g of abs(p_g - b_h) - abs(b_g - b_h)      only g has it
    + the same over the terms of h                                    only h has it
    + sum over shared terms of what the two corrections above got wrong.

Postings are cut by term into blocks. In a block each group is a row: it scatters its terms through
the block's term-major index into a dense accumulator with a place for every peer, so pairs of
postings are never rows. The second line comes from the row's sorted shares and their running sums,
one search a peer. A block gives one accumulator for each group in it; blocks are summed in Spark. All
sums are integers.

A block has about ``BLOCK`` postings however large the table is, and a term has one posting a group,
so a frequent term or a large source makes no large block. Words are counted in each task before the
shuffle, at most ``HELD`` entries at a time.

Null texts, languages and sources are empty ones. Repeated rows are documents each. Groups without
terms have ranks like others, at value V * abs(b - b), 0 where V is 0. An empty table gives no rows;
a language with one source has no pairs. Ids and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import byte_texts, pieces, stored

UNIT, PAD = 1_000_000_000, 5
BLOCK = 1 << 18
HELD = 1 << 18
#: Bytes of one text whose words are listed at a time.
LISTED = 1 << 20
_LETTERS = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256)
)
COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of one whole text, in lists of bounded size."""
    plain, begin = text.translate(_LETTERS), 0
    while begin < len(plain):
        end = begin + LISTED
        if end < len(plain):
            end = plain.find(b" ", end)
            end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


def _listed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        found = [x.decode() for x in n]
        columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
        columns += [pa.array(found, pa.string()), pa.array(n.values(), pa.int64())]
        columns.append(pa.array([docs[t] for t in n], pa.int64()))
        if len(n):
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``docs`` (lang, source, text), in parts still to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in pieces(batches, "text"):
            langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
            for lang, source, text in zip(langs, sources, byte_texts(batch["text"])):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in terms(text):
                    n.update(part)
                    seen.update(part)
                in_docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from _listed(held)
                held = {}
        yield from _listed(held)

    return docs.mapInArrow(run, COUNTS)


def share(count: Column | int, total: str, terms: str) -> Column:
    """1 + floor(unit * (count + pad) / (total + pad * terms)); null where there are no terms."""
    wide = "decimal(20,0)"
    above = F.lit(UNIT).cast(wide) * ((F.lit(count) if isinstance(count, int) else count) + PAD).cast(wide)
    below = F.nullif(F.col(total) + PAD * F.col(terms), F.lit(0)).cast(wide)
    return (F.floor((above - above % below) / below) + 1).cast("long")


def postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """Stored, per kept term and group that has it: lang, term, source, n, lang_n, lead.

    ``lead`` marks one posting of each term. One shuffle by term serves the sums and the choice.
    """
    dealt = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source")
    summed = dealt.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = summed.withColumn("in_docs", F.sum("docs").over(whole)).withColumn("lang_n", F.sum("n").over(whole))
    lead = F.row_number().over(whole.orderBy("source")) == 1
    kept = summed.withColumn("lead", lead).where(F.col("in_docs") >= least_docs)
    return stored(kept.select("lang", "term", "source", "n", "lang_n", "lead"), "postings")


def groups(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Stored, per group: lang, source, place (0, 1, ... in its language), total, lang_total, terms, base, blocks."""
    all_groups = docs.select("lang", "source").distinct()
    sums = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = index.groupBy("lang").agg(
        F.sum("n").alias("lang_total"),
        F.sum(F.col("lead").cast("long")).alias("terms"),
        (F.count(F.lit(1)) / BLOCK + 1).cast("int").alias("blocks"),
    )
    found = all_groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    found = found.fillna(0, ["total", "lang_total", "terms"]).fillna(1, ["blocks"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    base = F.coalesce(share(0, "total", "terms"), F.lit(0)).cast("long")
    return stored(found.withColumn("place", place).withColumn("base", base), "groups")


def corrections(p: np.ndarray, own: int, bases: np.ndarray) -> np.ndarray:
    """Per peer: the sum over a row's shares ``p``, none below ``own``, of abs(p - base) - abs(own - base)."""
    p = np.sort(p)
    run = np.concatenate(([0], np.cumsum(p)))
    below = np.searchsorted(p, bases)
    under = bases * below - run[below]
    over = (run[-1] - run[below]) - bases * (len(p) - below)
    return under + over - len(p) * abs(own - bases)


def accumulate(term: np.ndarray, place: np.ndarray, p: np.ndarray, bases: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, own, shared) of every group in a block: its corrections, and what shared terms change, per peer.

    ``term`` numbers the block's terms. The index lists the postings term after term; a row adds, for
    each of its terms, that stretch of the index to its accumulator.
    """
    by_term = np.argsort(term, kind="stable")
    peer, peer_p = place[by_term], p[by_term]
    ends = np.searchsorted(term[by_term], np.arange(term.max(initial=-1) + 2))
    by_row = np.argsort(place, kind="stable")
    rows, starts = np.unique(place[by_row], return_index=True)
    for row, begin, end in zip(rows.tolist(), starts, np.append(starts[1:], len(by_row))):
        mine, own = by_row[begin:end], bases[row]
        sizes = ends[term[mine] + 1] - ends[term[mine]]
        shift = np.repeat(ends[term[mine]] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        met = np.arange(sizes.sum()) + shift
        here, there, base = np.repeat(p[mine], sizes), peer_p[met], bases[peer[met]]
        shared = np.zeros(len(bases), np.int64)
        np.add.at(shared, peer[met], abs(here - there) - abs(here - base) - abs(own - there) + abs(own - base))
        yield row, corrections(p[mine], own, bases), shared


def distances(index: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, here, there, value) of all pairs of places of one language, both ways round."""
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    rows = index.join(found, ["lang", "source"])
    rows = rows.select("lang", block.alias("block"), "term", F.col("place").alias("row"), share(F.col("n"), "total", "terms").alias("p"))
    peers = found.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "place", "base", "terms")
    names = ["lang", "here", "own", "shared"]
    kinds = pa.schema([("lang", pa.string()), ("here", pa.int32()), ("own", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bases = np.zeros(right.num_rows, np.int64)
        bases[right["place"].to_numpy()] = right["base"].to_numpy()
        out = []
        if left.num_rows:
            coded = left["term"].combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            out += accumulate(coded.indices.to_numpy(), left["row"].to_numpy(), left["p"].to_numpy(), bases)
        if key[1].as_py() == 0 and right.num_rows:
            lacking, none = right["terms"][0].as_py(), np.zeros(len(bases), np.int64)
            out += [(i, none, lacking * abs(bases[i] - bases)) for i in range(len(bases))]
        lang = [key[0].as_py()] * len(out)
        return pa.Table.from_arrays([lang, *([x[i] for x in out] for i in range(3))], schema=kinds)

    made = rows.groupBy("lang", "block").cogroup(peers.groupBy("lang", "block"))
    made = made.applyInArrow(run, "lang string, here int, own array<long>, shared array<long>").toDF(*names)
    each = made.select("lang", "here", F.posexplode(F.arrays_zip("own", "shared")).alias("there", "sums"))
    both = each.select("lang", "here", "there", (F.col("sums.own") + F.col("sums.shared")).alias("value")).unionByName(
        each.select("lang", F.col("there").alias("here"), F.col("here").alias("there"), F.col("sums.own").alias("value"))
    )
    return both.where("here <> there").groupBy("lang", "here", "there").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least_docs: int = 30, most_terms: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    Part pair ranks every other source of the language by distance. Part term ranks the kept terms
    that the group has more often than the language does by the difference, ``most_terms`` at most.
    """
    named = [(lang_col, "lang"), (source_col, "source"), (text_col, "text")]
    read = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in named])
    index = postings(read, least_docs)
    found = groups(read, index)
    ends = [found.select("lang", F.col("place").alias(end), F.col("source").alias(name)) for end, name in (("here", "source"), ("there", "item"))]
    pairs = distances(index, found).join(ends[0], ["lang", "here"]).join(ends[1], ["lang", "there"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    over = share(F.col("n"), "total", "terms") - share(F.col("lang_n"), "lang_total", "terms")
    marked = index.join(found.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    marked = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value"))
    marked = marked.where("value > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms)
    return ranked.unionByName(marked)


ORACLE = r"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
        FROM documents),
    w AS (SELECT row, lang, source, unnest(found) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d),
    dense AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
        FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (
        SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER o + 5 * count(*) OVER o) AS p
        FROM dense WINDOW o AS (PARTITION BY lang, source)),
    l AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
    q AS (
        SELECT lang, term, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER o + 5 * count(*) OVER o) AS q
        FROM l WINDOW o AS (PARTITION BY lang)),
    pair AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    both_parts AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
        UNION ALL
        SELECT p.lang, p.source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
