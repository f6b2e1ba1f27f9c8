"""Quality bands, mixing, URL verdicts, chat formatting and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests import harness
from tests.llm import data
from tickloom.llm import chat_format, mixing, quality_rules, queries, url_filters

SF = "/root/testdata/sf0.001"


def counted(text):
    words = data.WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if data.WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_measures(spark):
    got = quality_rules.measure(data.docs(spark)).collect()
    want = sorted((i or 0, *counted(t or "")) for i, t, *_ in data.rows())
    assert sorted((r[0] or 0, *r[1:7]) for r in got) == want
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert quality_rules.measure(data.no_docs(spark)).count() == 0


def test_bands():
    rng = random.Random(5)
    noise = " ".join("".join(chr(rng.randrange(0x21, 0x7F)) for _ in range(9)) for _ in range(3000))
    loop = " ".join(f"item{i % 400} of{i // 400}" for i in range(6000))
    assert quality_rules.judged(data.prose(1, 300).encode())[6]
    assert quality_rules.judged(data.prose(1, 60).encode())[6]
    assert not quality_rules.judged(noise.encode())[6]
    assert not quality_rules.judged(("same words again and again " * 200).encode())[6]
    assert quality_rules.judged(loop.encode())[7] > 3
    assert quality_rules.chunk_cuts(0) == [(0, 0)] and quality_rules.chunk_cuts(9000) == [(0, 4096), (4096, 9000)]


def labelled(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_rules.measure(docs).join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id")
    return rows.where("NOT base_failed").selectExpr("quality", "lang", "kept", "ratio", "octet_length(text) AS size").toPandas()


def test_bands_are_the_fit_and_reject_junk(spark):
    rows = labelled(spark)
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    fit = quality_rules.fitted(good["size"].to_numpy(), good.ratio.to_numpy(), good.lang.to_numpy().astype(str))
    assert fit == list(quality_rules.BANDS)
    assert all((~r.kept).mean() <= 0.005 for _, r in good.groupby("lang"))
    assert (~bad.kept).mean() > 0.75 and (~bad[bad["size"] >= 2048].kept).mean() > 0.95


def test_bands_reject_by_themselves():
    rng = random.Random(6)
    for n in (60, 100, 300, 1000, 3000, 20000):
        assert quality_rules.judged(data.prose(9, n).encode())[5:7] == (False, True)
        coded = base64.b64encode(rng.randbytes(7 * n)).decode()
        lines = "\n".join(coded[i : i + 9] for i in range(0, len(coded), 9))
        assert quality_rules.judged(lines.encode())[5:7] == (False, False)
    listed = "\n".join(f"item{i} costs{i * 7 % 1000} euro{i * 31}" for i in range(300))
    signs = " ".join(w + rng.choice(["###", "$$$", "%%%", "&&&", "***"]) for w in data.prose(9, 1500).split())
    assert quality_rules.judged(listed.encode())[5:7] == (False, False)
    assert quality_rules.judged(signs.encode())[5:7] == (False, False)
    # half of the chunks, and no more, may be odd
    prose, odd = data.prose(9, 3000).encode()[:12288], b" ".join(b"no%d of" % i for i in range(9999))
    assert quality_rules.judged(prose)[8:] == (0, 3)
    assert quality_rules.judged(prose[:8192] + odd[:8192])[8] == 2


def test_keep_returns_rows(spark):
    docs = data.docs(spark)
    kept = quality_rules.keep(docs)
    assert kept.schema == docs.schema
    want = Counter(i for i, t, *_ in data.rows() if quality_rules.judged((t or "").encode())[6])
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert quality_rules.keep(data.no_docs(spark)).count() == 0


def filled(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in cut)
        share = sum(weight[s] for s in sizes if s not in cut)
        target = {s: 3 * sizes[s] if s in cut else left * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in cut and target[s] > 3 * sizes[s]}
        if not over:
            return target
        cut |= over


def test_mix(spark):
    docs = data.docs(spark)
    got = mixing.assign(docs).collect()
    sizes = defaultdict(int)
    for r in data.rows():
        sizes[r[3]] += len(data.WORD.findall(r[1] or ""))
    target = filled(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(data.WORD.findall(r[1] or ""))) for r in data.rows())
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(math.isclose(r["target"], target[s], rel_tol=1e-12) for r in own)
        assert sum(r["taken"] for r in own) == int(target[s] + 0.5)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all(0 <= r["first_position"] <= 1 for r in got if r["taken"])
    again = mixing.assign(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert mixing.assign(data.no_docs(spark)).count() == 0


def test_schedule_is_the_mix_in_order(spark):
    assigned = mixing.assign(data.docs(spark))
    mix = mixing.schedule(assigned)
    due = [r["position"] for r in mix.collect()]
    per_file = [[r["position"] or 0.0 for r in part] for part in mix.rdd.glom().collect()]
    assert all(part == sorted(part) for part in per_file) and len([x for x in due if x is not None]) > len(data.rows()) / 2
    told = Counter((r["doc_id"], r["size"], r["taken"], r["first_position"]) for r in assigned.collect())
    got = mixing.tally(mix).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"], r["first_position"]) for r in got) == told
    assert any(r["passes"] > 1 and r["last_position"] > r["first_position"] for r in got)
    assert all(r["passes"] == (math.ceil(r["taken"] / r["size"]) if r["taken"] else 0) for r in got)
    assert mixing.tally(mixing.schedule(mixing.assign(data.no_docs(spark)))).count() == 0


def test_curriculum_repeats_rows(spark):
    docs = data.docs(spark)
    rows = mixing.curriculum(docs).collect()
    assert mixing.curriculum(docs).schema == docs.schema
    copies = sum(r["copies"] for r in mixing.assign(docs).collect())
    assert len(rows) == copies > 0
    assert mixing.curriculum(data.no_docs(spark)).count() == 0


@pytest.mark.parametrize("curve", [*mixing.CURVES, ((0.0, 0.0), (0.5, 2.0), (0.7, 2.0), (1.0, 0.0))])
def test_moment_inverts_the_integral(spark, curve):
    segments = mixing._segments(curve)
    found = spark.range(21).select((mixing.moment(mixing.F.col("id") / 20.0, segments)).alias("t")).collect()

    def integral(t):
        done = 0.0
        for (a, v), (b, w) in zip(curve, curve[1:]):
            x = min(max(t - a, 0), b - a)
            done += v * x + (w - v) / (b - a) * x * x / 2
        return done

    for i, (t,) in enumerate(found):
        assert math.isclose(integral(t), integral(1) * i / 20, abs_tol=1e-9)


def test_urls(spark):
    urls = [
        "http://A.Example.ORG/es/1?x", "https://sub.example.org/en/12", "http://example.org", "http://x.com/de/5#a", None, "no scheme",
        "http://x.com/fr/5", "http://x.net/a/b/c/d/e/f", "http://org/", "://h/p", "http://x.com/de", "http://example.org/en/2", "http://notorg/",
        "ftp://u:p@h.com:80/de/1", "http://h\n.com/de/1\n2",
    ]
    want = [
        ("a.example.org", "/es/1", "example.org/es/"), ("sub.example.org", "/en/12", "example.org/en/1"), ("example.org", "", None),
        ("x.com", "/de/5", "com/de/"), ("", "", None), ("", "", None), ("x.com", "/fr/5", "com/fr/"), ("x.net", "/a/b/c/d/e/f", None),
        ("org", "/", "org/"), ("h", "/p", None), ("x.com", "/de", None), ("example.org", "/en/2", "org/"), ("notorg", "/", None),
        ("u:p@h.com:80", "/de/1", None), ("h\n.com", "/de/1\n2", "com/de/"),
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, urls[0], "h"), (None, urls[1], "h")], "page_id long, url string, host string")
    got = url_filters.judge(pages, queries.RULES).collect()
    assert len(got) == len(urls) + 2
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got if r["page_id"] is not None}
    assert [by_id[k] for k in range(len(urls))] == want
    assert url_filters.judge(pages.limit(0), queries.RULES).count() == 0


def test_templates_learn_from_rules(spark):
    made = [(f"http://h.com/de/{i}") for i in range(60)] + [f"http://h.com/de{i}x/q" for i in range(30)]
    made += [f"http://good.com/fr/{i}" for i in range(60)] + ["http://good.com/xx/1", "http://h.com/zz/9", "http://other.net/a"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judge(pages, queries.RULES).collect()}
    assert got[made.index("http://h.com/zz/9")]["verdict"] == "block"
    assert got[made.index("http://good.com/xx/1")]["verdict"] == "allow"
    assert got[made.index("http://other.net/a")]["verdict"] == "allow"
    assert got[61]["template"] == "/*/q"


def test_similar_siblings_are_merged(spark):
    rows = [("h", "/a/1", 40, 20, 16), ("h", "/b/1", 40, 18, 14), ("h", "/c/1", 60, 30, 0), ("h", "/d/1", 40, 0, 0)]
    rows += [("h", f"/rare{i}/1", 3, 0, 0) for i in range(9)] + [("h", "", 1, 0, 0)]
    rows += [("deep", "/y" * 9, 4096, 0, 0), ("short", "/y" * 9, 40, 0, 0)]
    paths = spark.createDataFrame(rows, "host string, path string, pages long, labels long, blocked long")
    found, levels = url_filters.templates(paths)
    assert levels == 9
    shown = {(r["host"], r["path"]): r[f"t{levels}"] for r in found.collect()}
    assert shown["h", "/a/1"] == "/a/*" and shown["h", "/rare3/1"] == "/*/*" and shown["h", ""] == ""
    assert shown["deep", "/y" * 9] == "/y" * 9 and shown["short", "/y" * 9] == "/y/y/y/**"
    purity = {(r["host"], r["template"]): r["purity"] for r in url_filters.purities(found, levels).collect()}
    host = 30 / 68
    for branch, want in {"/a/*": (30 + 10 * host) / 48, "/b/*": (30 + 10 * host) / 48, "/c/*": 10 * host / 40, "/d/*": host, "/*/*": host}.items():
        assert math.isclose(purity["h", branch], want), branch


def chats():
    odd = "\\### Assistant: </turn> ok"
    rng = random.Random(4)
    bits = ["\\", "###", "</turn>", "\n", ": ", "a", "### user: ", "\\\\", "é"]
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (2, 0, "assistant", None), (2, 0, "assistant", None),
        (3, 5, None, "x"), (3, None, "we:ird ### role", "y"), (None, 1, "user", "q"), (None, 2, "assistant", ""), (4, 0, "user", ""),
    ]
    rows += [(5, i, ("user", "assistant")[i % 2], "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(9000)]
    return rows


def test_chat(spark):
    rows = chats()
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, place string, segments string")
    turns = chat_format.format_turns(table.repartition(3))
    got = {r["conv_id"]: r for r in chat_format.read_back(turns).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    for c, group in groups.items():
        group.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in group)
        loss = "".join(t for _, _, r, t in group if r == "assistant")
        assert got[c]["n_turns"] == len(group)
        assert got[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False, 5: True}
    at = defaultdict(int)
    for r in sorted(turns.collect(), key=lambda r: (repr(r["conv_id"]), r["place"])):
        assert r["begin"] == at[r["conv_id"]]
        at[r["conv_id"]] += sum(len(s["text"]) for s in r["segments"])
    assert all(got[c]["formatted_chars"] == n for c, n in at.items())
    assert chat_format.read_back(chat_format.format_turns(table.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    problem = harness.compare(queries.QUERIES[name](spark, SF), harness.connect(SF), queries.ORACLES[name])
    assert problem is None, problem


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert after.columns == columns
        seen.append((before, after))
        before = after
    texts = [r["text"] for r in seen[1][1].collect()]
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts}) == len(texts)
    ids = {r["doc_id"]: r["text"] for r in seen[3][1].collect()}
    for r in seen[4][1].collect():
        assert r["decoded_sha256"] == hashlib.sha256(ids[r["doc_id"]].encode()).hexdigest()
    assert seen[4][1].count() == seen[3][1].count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_on_odd_and_empty_documents(spark):
    for docs in (data.docs(spark), data.no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), "odd")
        docs.count()
