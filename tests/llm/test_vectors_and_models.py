"""Clusters, source divergence and the quality model against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from tests.llm import data
from tickloom.llm import centroids, divergence, quality_model, queries

SCALES = Path("/root/testdata")


def vector_rows():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        middle = [3.0, -2.0, 0.0][i % 3]
        rows.append((i, [middle * (d % 4) + rng.gauss(0, 0.7) for d in range(6)]))
    rows += [(900 + i, [0.5] * 6) for i in range(60)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, [1.0] * 6), (None, [1.0] * 6)]
    rows += [(800, None), (801, []), (802, [1.0] * 5), (803, [1.0] * 7), (804, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(805, [math.nan] + [0.0] * 5), (806, [math.inf] + [0.0] * 5), (807, [-0.0] * 6), (808, [-0.01] * 6)]
    return [(i, v, "x", 1) for i, v in rows]


VECTORS = "vec_id long, embedding array<double>, vector string, cluster int"


def plain_clusters(rows, k, rounds, seed, dim, scale):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(scale * x) for x in v)))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        for c, vs in held.items():
            middles[c] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, c in out:
        sums[c] += d
    told = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return sorted(((i, c, d, sums[c], sum(sums.values()), told[c]) for i, d, c in out), key=repr)


@pytest.mark.parametrize("k, rounds, scale", [(8, 10, 64), (3, 2, 1024), (1, 2, 16)])
def test_clusters_equal_plain_k_means(spark, k, rounds, scale):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = centroids.clusters(df, k=k, rounds=rounds, seed=3, dim=6, scale=scale)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_clusters(rows, k, rounds, 3, 6, scale)


def test_clusters_of_few_or_no_vectors(spark):
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).collect() == []
    few = [(1, [1.0, 2.0], "x", 1), (2, [1.0, 2.0], "x", 1), (3, None, "x", 1)]
    found = centroids.clusters(spark.createDataFrame(few, VECTORS), k=8, dim=2).select("vec_id", "cluster", "inertia").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 0), (2, 0, 0)]


def test_too_large_components_are_refused(spark):
    big = spark.createDataFrame([(1, [1e12, 0.0], "x", 1), (2, [0.0, 0.0], "x", 1)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(big, dim=2).collect()


def test_planar_loosening_bounds_every_vector_and_beats_the_drift():
    rng = np.random.RandomState(1)
    tighter = 0
    for _ in range(60):
        before = rng.randint(-900, 900, (5, 4)).astype(float)
        after = before + rng.randint(-60, 60, (5, 4))
        after[2] = before[2]
        radius = rng.uniform(1, 700, 5)
        found = centroids.planar_loosening(before, after, radius)
        full = np.sqrt(((after - before) ** 2).sum(1))
        for i in range(5):
            around = rng.normal(size=(4000, 4))
            around *= radius[i] * rng.uniform(0, 1, (4000, 1)) ** 0.25 / np.sqrt((around**2).sum(1, keepdims=True))
            x = before[i] + around
            lost = [np.sqrt(((x - before[j]) ** 2).sum(1)) - np.sqrt(((x - after[j]) ** 2).sum(1)) for j in range(5) if j != i]
            assert np.max(lost) <= found[i] + 1e-9
            most = np.delete(full, i).max()
            assert found[i] <= most * (1 + 1e-6)
            tighter += found[i] < 0.9 * most
    assert tighter > 100


def test_bounds_spare_most_scans():
    rng = np.random.RandomState(2)
    middles = rng.randint(-1000, 1000, (6, 8))
    x = (middles[rng.randint(0, 6, 5000)] + rng.randint(-90, 90, (5000, 8))).astype("<i4")
    start = centroids.Bounds(np.zeros(6), np.zeros(6), np.full(6, -np.inf))
    state = centroids.settle(x, np.zeros(5000, np.int64), np.full(5000, np.inf), np.full(5000, -np.inf), middles, start)
    assert state[3] == 5000
    radius = np.array([state[1][state[0] == c].max(initial=0) for c in range(6)])
    after = middles + rng.randint(-20, 20, (6, 8))
    cluster, _, _, scanned = centroids.settle(x, *state[:3], after, centroids.bounds(middles, after, radius))
    assert scanned < 500
    assert (cluster == centroids.distances(x, after).argmin(1)).all()


def plain_audit(rows, least_docs, most_terms):
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(r[2] or "", r[3] or "", letters.findall((r[1] or "").translate(lower))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in in_docs.items() if n >= least_docs]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if in_docs[t] >= least_docs) for s in {d[1] for d in mine}}
        everything = sum(counts.values(), Counter())

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(everything)
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, most_terms)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def source_rows():
    rng, rows = random.Random(8), []
    for i in range(220):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"])
        words = [f"{rng.choice(['Wört', 'word', 'WORD', 'x', 'zé'])}{rng.choice('abcdefghij')}" for _ in range(rng.randint(0, 25))]
        rows.append((i, rng.choice([" ", ", ", "9"]).join(words), lang, source, 0))
    rows += [(300, None, "en", "empty", 0), (301, "", "xx", "one", 0), (302, "!!", "xx", "two", 0), (303, "alone", "yy", "s", 0)]
    rows += [(304, "word " * 400_000 + "Last", "en", "a", 0), (304, "word repeated", "en", "a", 0), (304, "word repeated", "en", "a", 0)]
    return [(*r, "x", "y", 7) for r in rows]


SOURCES = "doc_id long, text string, lang string, source string, n_chars long, term string, place string, rank int"


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_divergence_equals_dense_sums(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", block)
    rows = source_rows()
    found = divergence.audit(spark.createDataFrame(rows, SOURCES).repartition(5), least_docs=3, most_terms=4)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 3, 4)


def test_divergence_of_no_documents(spark):
    found = divergence.audit(spark.createDataFrame([], SOURCES))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and found.collect() == []


def test_words_of_long_texts_are_all_listed(monkeypatch):
    monkeypatch.setattr(divergence, "LISTED", 10)
    text = "Ab cd,ef " * 50 + "gh" * 40 + " \x00 ij\x7fkl"
    assert [t for part in divergence.terms(text.encode()) for t in part] == re.findall(rb"[a-z]+", text.lower().encode())


def test_follow_equals_a_plain_learner():
    rng, how = random.Random(3), quality_model.Training(bits=5, epochs=3, alpha=0.3, l1=0.02, l2=0.2)
    rows = []
    for _ in range(80):
        at = np.array(sorted(rng.sample(range(31), 6)) + [31])
        rows.append((at, np.array([rng.random() for _ in at]), rng.randint(0, 1)))
    z, n, w = [0.0] * 32, [0.0] * 32, [0.0] * 32

    def weigh(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return (math.copysign(how.l1, z[i]) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for at, values, label in rows * how.epochs:
        for i in at:
            w[i] = weigh(i)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, values))))
        for i, v in zip(at, values):
            g = (p - label) * v
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
            z[i] += g - s * w[i]
            n[i] += g * g
    assert np.allclose(quality_model.follow(rows, how), [weigh(i) for i in range(32)])


def test_features_of_whole_texts(monkeypatch):
    text = data.prose(9, 5000).encode()
    whole = quality_model.features(text, quality_model.Hashes(), 18)
    monkeypatch.setattr(quality_model, "LISTED", 50)
    monkeypatch.setattr(quality_model, "REMEMBERED", 10)
    cut = quality_model.features(text, quality_model.Hashes(), 18)
    assert all((a == b).all() for a, b in zip(whole, cut))
    at, value = quality_model.features(b"", quality_model.Hashes(), 18)
    assert at.tolist() == [(1 << 18) - 1] and value.tolist() == [1.0]


def test_quality_is_learned_and_held_out_rows_are_right(spark):
    docs, labels = (spark.read.parquet(str(SCALES / "sf0.01" / f"{t}.parquet")) for t in ("documents", "labels"))
    found = queries.QUERIES["op13_quality_model"](spark, str(SCALES / "sf0.01")).collect()
    assert len(found) == docs.count()
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    judged = [(told[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and told.get(r["doc_id"]) is not None]
    for label in (0, 1):
        mine = [p == label for t, p in judged if t == label]
        assert len(mine) > 10 and sum(mine) >= 0.95 * len(mine)


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(str(SCALES / "sf0.001" / "documents.parquet"))
    labels = spark.read.parquet(str(SCALES / "sf0.001" / "labels.parquet"))
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - quality, quality) AS quality")
    a, b = ({r["doc_id"]: r["score"] for r in quality_model.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_the_sample_is_bounded_and_odd_rows_are_scored(spark):
    docs = data.docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 1), (10, 0), (12, 1), (9, 1), (None, 0), (13, None), (15, 7)], "doc_id long, quality int")
    how = quality_model.Training(sample=3, shard_rows=2)
    used = quality_model.sample(docs, labels, "doc_id", "text", "quality", how).collect()
    fair = {i for i in (1, 4, 10, 12, 9) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(used) == min(3, len(fair)) and {r["doc_id"] for r in used} <= fair
    found = quality_model.classify(docs, labels, how).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in data.rows())
    empty = {r["doc_id"]: r["score"] for r in found}
    assert empty[5] == empty[6] == empty[7] == empty[-3]
    unlabelled = quality_model.classify(docs, labels.limit(0), how).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in unlabelled)
    assert quality_model.classify(data.no_docs(spark), labels, how).collect() == []
