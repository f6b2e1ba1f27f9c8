"""Byte-level BPE, token files and separator scan against the libraries and plain counting."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import data
from tickloom.llm import bpe, token_counts, token_files
from tickloom.llm.common import work_folder

RANKS = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), "ranks")
JSON = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.read_ranks(RANKS.path)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=[RANKS, JSON], ids=["ranks", "json"])
def encoder(request):
    return bpe.Encoder(request.param, limit=500)


@pytest.fixture(scope="module", params=[RANKS, JSON], ids=["ranks", "json"])
def decoder(request):
    return bpe.Decoder(request.param)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.dtype)


def test_encodes_as_the_reference_library(encoder, decoder, plain):
    rng = random.Random(3)
    alphabet = "abetinhso THE  .,'s\n\té1²½Ⅷ中文😀́​\xa0\x1c-_#$%\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [f"a{chr(c)}1 {chr(c)} x.{chr(c)} \n{chr(c)}b" for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["", " ", "\n", "  ", "a ", " a", "a\n", "<|endoftext|>", "\n\nx"]
    for text in texts:
        found = ids(encoder, text)
        assert found.tolist() == plain.encode_ordinary(text), ascii(text)
        assert decoder.decode(found) == text.encode()


@settings(deadline=None, max_examples=60)
@given(st.text())
def test_round_trip_and_split_characters(text):
    use = bpe.decoder(RANKS)
    found = ids(bpe.encoder(RANKS), text)
    assert use.decode(found) == text.encode()
    assert "".join(use.text_of_tokens(found)) == text
    half = len(found) // 2
    assert use.decode(found[:half]) + use.decode(found[half:]) == text.encode()


def test_words_of_letters_as_the_reference_library():
    """Letters of one or more bytes, on both sides of the point up to which letters are settled."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, plain = bpe.Encoder(bpe.Vocabulary(path, special=True), limit=50), Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = "aZqs\u00aa\u00ba\u00b5\u00df\u00e9\u01c5\u024f\u0250\u02b0\u0301\u0430\u4e2d\U0001d400"
    for _ in range(3000):
        text = rng.choice([" ", "", "\n", "  "]).join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(4))
        found = np.frombuffer(ours.encode(text), ours.dtype).tolist()
        assert found == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_spans_cover_the_text(encoder, decoder):
    for text in ("naïve 中文 déjà vu 😀😀", "plain words, here"):
        found = ids(encoder, text)
        starts, stops = decoder.spans(text.encode(), found)
        assert "".join(dict.fromkeys(text)) == "".join(dict.fromkeys("".join(text[a:b] for a, b in zip(starts, stops))))
        assert starts[0] == 0 and stops[-1] == len(text) and (starts < stops).all()


def test_encode_and_decode_tables(spark, plain):
    docs = data.docs(spark)
    coded = bpe.encode(docs, RANKS, offsets=True)
    got = sorted((r["doc_id"] or 0, tuple(r["ids"]), len(r["starts"])) for r in coded.collect())
    want = [(i or 0, tuple(plain.encode_ordinary(t or "")), len(plain.encode_ordinary(t or ""))) for i, t, *_ in data.rows()]
    assert got == sorted(want)
    back = bpe.decode(coded.select("doc_id", "ids"), RANKS).collect()
    assert sorted((r[0] or 0, bytes(r[1])) for r in back) == sorted((i or 0, (t or "").encode()) for i, t, *_ in data.rows())
    both = bpe.encode(docs, RANKS, decoded=True).select("doc_id", "decoded").collect()
    assert sorted((r[0] or 0, bytes(r[1])) for r in both) == sorted((r[0] or 0, bytes(r[1])) for r in back)
    assert bpe.decode(bpe.encode(data.no_docs(spark), RANKS), RANKS).count() == 0
    assert [bytes(r[1]) for r in bpe.decode(spark.createDataFrame([(1, None)], "a int, ids array<int>"), RANKS).collect()] == [b""]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 7, 900, 10**6], list(range(0, 9000, 3)), [0] * 700 + [1 << 40]])
def test_elias_fano(values):
    coded = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.select(0, len(values)).tolist() == values
    for i in range(0, len(values), 37):
        for n in (1, 2, 255, 256, 257, 1000):
            assert coded.select(i, min(i + n, len(values))).tolist() == values[i : i + n]
    if len(values) > 1000:
        assert len(coded.to_bytes()) < 8 * len(values) / 6


def test_token_files(spark, plain, tmp_path, monkeypatch):
    listing = token_files.write(data.docs(spark), str(tmp_path), JSON, 0, files=3)
    got = token_files.read(listing).collect()
    order = sorted(data.rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, np.array([*plain.encode_ordinary(t or ""), 0], "<u4")) for i, t, *_ in order]
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted(
        (i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want
    )
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    file = token_files.TokenFile(sorted(r["file"] for r in listing.collect())[0])
    whole = [(k, b, x.tolist()) for k, b, x in file.documents()]
    assert len(whole) == file.docs
    for first in range(file.docs):
        for last in range(first, file.docs + 1):
            assert [(k, b, x.tolist()) for k, b, x in file.documents(first, last)] == whole[first:last]
    monkeypatch.setattr(token_files, "READ_DOCS", 2)
    assert sorted(map(repr, token_files.read(listing).collect())) == sorted(map(repr, got))
    empty = token_files.write_and_read(data.no_docs(spark), JSON, 0)
    assert empty.count() == 0


def test_special_strings_as_the_library_by_default():
    library = Tokenizer.from_file(JSON.path)
    use = bpe.Encoder(bpe.Vocabulary(JSON.path, special=True))
    for text in ("x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endoftext", "plain  text\n", ""):
        assert ids(use, text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 50256 in ids(use, "x <|endoftext|> y") and 50256 not in ids(bpe.Encoder(JSON), "x <|endoftext|> y")


def test_separator_scan(spark, plain):
    folder = work_folder(spark, "flat")
    listing = token_counts.write_flat(data.docs(spark), folder, JSON, 50256)
    for block in (1 << 20, 1000, 7):
        if block == 7:
            folder = work_folder(spark, "flat")
            listing = token_counts.write_flat(data.docs(spark).where("length(coalesce(text, '')) < 1500"), folder, JSON, 50256)
        found = listing.join(token_counts.scan(spark, folder, 50256, block=block), ["file", "ordinal"], "left")
        got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found.collect())
        rows = [r for r in data.rows() if block != 7 or len(r[1] or "") < 1500]
        assert got == sorted((i or 0, len(plain.encode_ordinary(t or ""))) for i, t, *_ in rows)


def test_scan_of_odd_files(spark, tmp_path):
    for name, ids_ in {"a": [], "b": [9], "c": [9, 9, 1, 9, 2, 3], "d": [1, 2, 3, 4, 5]}.items():
        np.array(ids_, "<u2").tofile(tmp_path / f"{name}.bin")
    got = token_counts.scan(spark, str(tmp_path), 9, block=2).orderBy("file", "ordinal").collect()
    assert [tuple(r) for r in got] == [
        ("b.bin", 0, 0, 0, True), ("c.bin", 0, 0, 0, True), ("c.bin", 1, 1, 0, True), ("c.bin", 2, 2, 1, True),
        ("c.bin", 3, 4, 2, False), ("d.bin", 0, 0, 5, False),
    ]
