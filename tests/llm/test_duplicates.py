"""Exact, near and line duplicates against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.llm import data
from tickloom.llm import components, exact_dedup, line_dedup, simhash


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[normal(t)].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        kept = 0
        for i in ids:
            stays = i == keep and not kept
            kept += stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.md5, lambda c: F.length(c) % 2], ids=["md5", "colliding"])
def test_exact(spark, digest):
    got = exact_dedup.decisions(data.docs(spark), digest=digest).collect()
    assert sorted(map(tuple, got), key=repr) == exact_expected(data.rows())
    assert exact_dedup.decisions(data.no_docs(spark)).count() == 0


def test_exact_rows_keep_all_columns(spark):
    docs = data.docs(spark)
    kept = exact_dedup.kept_rows(docs)
    assert kept.schema == docs.schema
    want = [(i, s) for i, _, _, stays, s in exact_expected(data.rows()) if stays]
    got = [(r["doc_id"], hashlib.sha256(normal(r["text"]).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.kept_rows(data.no_docs(spark)).count() == 0


def print_of(text, shingle):
    words = data.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_close_fingerprints(spark):
    rows = data.rows()
    prints = [print_of(r[1], 3) for r in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = defaultdict(list)
    for i, root in enumerate(roots(len(rows), near)):
        groups[root].append(i)
    want = []
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        want += [(rows[i][0], f"{prints[i]:016x}", least) for i in members]
    docs = spark.createDataFrame(rows, data.SCHEMA)
    got = simhash.near_duplicates(docs, index=simhash.CLOSE).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(data.no_docs(spark), index=simhash.CLOSE).count() == 0


@pytest.mark.parametrize(("distance", "radius", "per_word"), [(3, 1, 2), (5, 1, 3), (5, 2, 2)])
def test_every_link_within_reach_is_met(spark, distance, radius, per_word):
    base = [int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16) for i in range(30)]
    values = {b ^ sum(1 << (7 * k + 11 * i) % 64 for i in range(k)) for b in base for k in range(8)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v, [v]) for v in signed], "node long, print array<long>")
    index = simhash.Index(words=1, per_word=per_word, radius=radius, distance=distance)
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= distance}
    assert {tuple(r) for r in simhash.links(table, index).collect()} == want


def test_what_is_looked_up_and_the_prints_are_never_broadcast(spark, monkeypatch):
    """Spark sizes these sides by their files, before they are exploded: small tables would be broadcast."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    nodes = spark.range(500).selectExpr("id * 7919 AS node", "array(id * 7919) AS print")
    assert "SortMergeJoin" in (made := plan(simhash.links(nodes, simhash.CLOSE))) and "Broadcast" not in made
    docs = data.docs(spark)
    assert "SortMergeJoin [print" in plan(simhash.near_duplicates(docs, index=simhash.CLOSE))
    plans, plain = {}, simhash.Scratch.stored

    def keeping(self, df, label):
        plans[label] = plan(df)
        return plain(self, df, label)

    monkeypatch.setattr(simhash.Scratch, "stored", keeping)
    assert "SortMergeJoin [print" in plan(simhash.near_duplicates(docs))
    assert "SortMergeJoin [key" in plans["asks"] and "Broadcast" not in plans["asks"]


def test_one_of_each(spark):
    docs = data.docs(spark)
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    # 2 and 11 have the words of 1, 3 is edited lightly, 15 is upper case; 6, 7 and -3 have no words, nor has 5
    assert {1, 4, 8, 9, 10, 12, 13, 14, None, -3} == set(ids)
    assert ids[12] == 2 and ids[None] == 1
    assert simhash.one_of_each(data.no_docs(spark)).count() == 0


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_against_brute_force(spark):
    rng, rows = random.Random(11), []
    for asked in (0.7, 0.8, 0.85, 0.9):
        for k in range(150):
            # words are replaced one by one while the pair stays at the similarity asked for; at 0.7 one more
            words = [f"w{rng.randrange(9000)}" for _ in range(300)]
            copy, base = list(words), shingled(" ".join(words))
            places = iter(rng.sample(range(300), 300))
            while True:
                at = next(places)
                tried = [*copy[:at], f"v{at}", *copy[at + 1 :]]
                other = shingled(" ".join(tried))
                if len(base & other) < asked * len(base | other):
                    break
                copy = tried
            if asked == 0.7:
                copy = tried
            rows += [(len(rows), " ".join(words), asked), (len(rows) + 1, " ".join(copy), asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, asked double")
    got = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    met, of = Counter(), Counter()
    for (i, a, asked), (j, b, _) in zip(rows[::2], rows[1::2]):
        a, b = shingled(a), shingled(b)
        assert i in got
        assert (len(a & b) >= 0.8 * len(a | b)) == (asked != 0.7)
        of[asked] += 1
        met[asked] += j not in got
    assert met[0.7] == 0
    assert met[0.8] >= 0.94 * of[0.8] and met[0.85] >= 0.97 * of[0.85] and met[0.9] >= 0.99 * of[0.9], met


@pytest.mark.parametrize("nodes", [1, 600, 200_000, 10**10])
def test_segments_keep_chance_meetings_few_and_recall_high(nodes):
    segments = simhash.SIMILAR.segments(nodes)
    count, width = segments.shape
    assert count * (width + 1) * nodes / 2**width < 120
    assert all(len(set(row)) == width for row in segments.tolist()) and segments.max() < 768
    rng, differ = np.random.RandomState(3), 0.1515
    flips = rng.random_sample((4000, 768)) < differ
    met = np.zeros(4000, bool)
    for row in segments:
        met |= flips[:, row].sum(1) <= 1
    # Segments of many orders of the same bits are not independent: 97 % at 200,000 prints, 92 % at 10**10.
    assert met.mean() > (0.955 if nodes < 10**6 else 0.915)
    assert (flips.sum(1) <= simhash.SIMILAR.distance).mean() > 0.995


def test_hubs_leave_the_components(spark):
    """Near copies of one text, a chain of edits and single texts, with and without rounds of hubs."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(60)] + [[f"y{rng.randrange(9000)}" for _ in range(200)] for _ in range(20)]
    chain = [f"z{rng.randrange(9000)}" for _ in range(200)]
    for k in range(30):
        chain = [*chain[: 6 * k], f"c{k}", *chain[6 * k + 1 :]]
        texts.append(chain)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingled(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = dict(enumerate(roots(len(rows), near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hubs in (0, 2):
        got = simhash.near_duplicates(docs, index=simhash.Similar(hubs=hubs)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_families_of_edited_copies_are_not_compared_in_full(spark, monkeypatch):
    """Copies of one text with up to six edits of their own: hubs join most, and the rest are ruled out by their shingles."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 2, 3, 4, 5, 6))):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    compared, plain = [], simhash.similar

    def counting(docs, nodes, pairs, *rest):
        compared.append(pairs.count())
        return plain(docs, nodes, pairs, *rest)

    monkeypatch.setattr(simhash, "similar", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, simhash.near_duplicates(docs, index=x).collect())) for x in (simhash.Similar(), simhash.Similar(hubs=0, crowd=1 << 40))]
    # without hubs and counts all links that are met are found, so the components must be the same
    assert found[0] == found[1]
    assert compared[2] < 0.15 * 240 * 239 / 2, compared


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 140)]
    got = components.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lines_expected(rows):
    rows = {(i, t or "") for i, t, *_ in rows}
    lines, first = [], {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            lines.append(((i is None, i or 0, t, k), frozenset(data.WORD.findall(line))))
    for place, words in lines:
        if words:
            first[words] = min(first.get(words, place), place)
    links, gone = Counter(), set()
    for a, b in itertools.combinations(first, 2):
        if 9 * len(a & b) >= 4 * (len(a) + len(b)):
            links.update((a, b))
            gone.add(max((a, b), key=first.get))
    out = defaultdict(lambda: [0, 0, []])
    for place, words in lines:
        entry = out[place[:3]]
        entry[0] += 1
        if words:
            entry[1] += links[words]
            if words in gone or first[words] != place:
                entry[2].append(place[3])
    return {k: (n, c, sorted(g)) for k, (n, c, g) in out.items()}


def line_rows():
    long = " ".join(f"w{i}" for i in range(40))
    texts = [
        (1, f"{long}\nshort line here\n\nshort line here"),
        (2, f"{long} extra\n{long.replace('w7', 'v7')}\nshort line there"),
        (3, long.replace("w3 ", "").replace("w4 ", "").replace("w5 ", "") + "\n a b c d e \ne d c b a a"),
        (4, "a b c d e f\na b c d\n" + long.replace("w", "q")),
        (5, None), (6, ""), (7, "short line here"), (7, "short line here"), (None, "a b c d e\nown words only"),
        (8, "the\nof\nthe of\nof the\nthe of and\n" + long),
    ]
    return [(i, t, "en", "s", 0, *["x"] * len(data.CLASHING)) for i, t in texts]


@pytest.mark.parametrize("rows", [line_rows(), [r for r in data.rows() if len(r[1] or "") < 100_000]], ids=["made", "texts"])
def test_lines(spark, rows):
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(2)
    want = lines_expected(rows)
    keys = {(r[0], h): (r[0] is None, r[0] or 0, r[1] or "") for r, (h,) in zip(rows, spark.createDataFrame(
        [(r[1] or "",) for r in rows], "t string").select(F.xxhash64("t")).collect())}
    got = line_dedup.decisions(docs).collect()
    found = {keys[r["doc_id"], r["hash"]]: (r["n_lines"], r["n_links"], list(r["removed"])) for r in got}
    assert found == want and len(found) == len({(r[0], r[1] or "") for r in rows})
    cleaned = line_dedup.cleaned(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        assert r["kept"] == "x"
    assert cleaned.count() == len(rows)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.decisions(data.no_docs(spark)).count() == 0
    assert line_dedup.cleaned(data.no_docs(spark)).count() == 0


def family(most):
    """240 lines that are copies of one with one edit or up to ``most``, some edits shared, and 60 lines half like it."""
    rng = random.Random(14)
    base = [f"w{k}" for k in range(60)]
    lines = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(1, most) if i < 240 else 24):
            words[at] = rng.choice((f"e{i}x{at}", f"e{at}"))
        lines.append(" ".join(words[rng.randrange(3) :]))
    return [(i, "\n".join((lines[i], f"own line {i}", lines[(7 * i) % 300])), "en", "s", 0, *["x"] * len(data.CLASHING)) for i in range(300)]


def pairs_made(spark, rows):
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(2)
    source = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return line_dedup.candidates(line_dedup.entries(source, *line_dedup.survey(source))).count()


@pytest.mark.parametrize("least", [8, 1 << 40], ids=["hubs", "no hubs"])
def test_lines_of_a_family(spark, monkeypatch, least):
    monkeypatch.setattr(line_dedup, "FAMILY", least)
    test_lines(spark, family(9))


def test_links_of_a_family_are_counted_without_its_pairs(spark, monkeypatch):
    rows = family(2)
    monkeypatch.setattr(line_dedup, "FAMILY", 8)
    counted = []
    plain = line_dedup.family_links

    def counting(classes, hubs):
        counted.append(plain(classes, hubs))
        return counted[0]

    monkeypatch.setattr(line_dedup, "family_links", counting)
    line_dedup.decisions(spark.createDataFrame(rows, data.SCHEMA)).count()
    sets = [frozenset(data.WORD.findall(x)) for x in {line for r in rows for line in r[1].split("\n")}]
    links = sum(9 * len(a & b) >= 4 * (len(a) + len(b)) for a, b in itertools.combinations(set(sets), 2))
    made = pairs_made(spark, rows)
    assert made + counted[0].count() / 2 < 0.2 * links


def test_lines_half_alike_are_no_candidates(spark):
    rng = random.Random(15)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(f"e{i}x{k}" if k in some else w for k, w in enumerate(base)) for i in range(100) for some in [set(rng.sample(range(100), 30))]]
    rows = [(i, t, "en", "s", 0, *["x"] * len(data.CLASHING)) for i, t in enumerate(texts)]
    assert pairs_made(spark, rows) < 100


def edited():
    """240 copies of a line of 60 words that lack one to six of the same twelve words and have one to three words of their own."""
    rng = random.Random(16)
    base = [f"w{k}" for k in range(60)]
    lines = []
    for i in range(240):
        lost = rng.sample(base[:12], rng.randint(1, 6))
        lines.append(" ".join([w for w in base if w not in lost] + [f"e{i}x{k}" for k in range(rng.randint(1, 3))]))
    return [(i, f"{line}\nown line {i}", "en", "s", 0, *["x"] * len(data.CLASHING)) for i, line in enumerate(lines)]


@pytest.mark.parametrize("together", [7, 1 << 12])
def test_links_by_shared_differences_make_no_row_a_pair(spark, monkeypatch, together):
    monkeypatch.setattr(line_dedup, "FAMILY", 8)
    monkeypatch.setattr(line_dedup, "TOGETHER", together, raising=False)
    counted = []
    plain = line_dedup.family_links

    def counting(classes, hubs):
        counted.append((classes.where("hub IS NOT NULL").select(F.sum(F.size("differ"))).first()[0], plain(classes, hubs)))
        return counted[-1][1]

    monkeypatch.setattr(line_dedup, "family_links", counting)
    test_lines(spark, edited())
    differing, found = counted[0]
    # at most one row for a set and one for each of its differing words, where these meet in one group
    if together > 240:
        assert found.count() <= differing + 240
    assert found.agg(F.sum("n_links")).first()[0] > 5 * (differing + 240)


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_ranges_and_groups_come_whole(monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MET", most)
    monkeypatch.setattr(line_dedup, "GATHERED", most)
    rng = random.Random(17)
    low, count = ([rng.randrange(n) for _ in range(40)] for n in (90, 9))
    want = [(i, x) for i in range(40) for x in range(low[i], low[i] + count[i])]
    found = list(line_dedup.spans(np.array(low), np.array(count)))
    assert [pair for w, at in found for pair in zip(w.tolist(), at.tolist(), strict=True)] == want
    assert all(len(w) <= most for w, _ in found) and not list(line_dedup.spans(np.empty(0, np.int64), np.empty(0, np.int64)))
    rows = pa.table({"a": sorted(rng.randrange(12) for _ in range(200)), "b": list(range(200))})
    got = list(line_dedup.whole_groups(iter(rows.to_batches(max_chunksize=7)), ["a"]))
    assert [x for t in got for x in t["b"].to_pylist()] == list(range(200))
    assert sum(len(set(t["a"].to_pylist())) for t in got) == len(set(rows["a"].to_pylist()))


def test_words_are_ordered_by_the_whole_hash_where_its_first_bits_are_equal():
    levels = np.zeros(line_dedup.BUCKETS, np.uint8)
    words = np.array([5, 3, 1 << 60, 3, 4, 5, 7], np.uint64)
    for order in ([0, 1, 2, 3, 4, 5, 6], [3, 2, 5, 4, 1, 0, 6]):
        sets = line_dedup.Sets.__new__(line_dedup.Sets)
        sets.arrange(words[order], np.array([0] * 6 + [9], np.int32), levels)
        assert sets.words(0).tolist() == [3, 4, 5, 1 << 60] and sets.words(1).tolist() == [7]
