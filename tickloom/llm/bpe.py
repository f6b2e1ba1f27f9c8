"""Byte-level BPE with the tokenizers library over Arrow batches, and its inverse.

The library works on characters: every byte is shown as one printable character. Encoding maps
text bytes to those characters, decoding reverses the table. Token offsets in characters of the
text come from a byte-to-character map, so a token that holds part of a character spans all of it.

White space never follows other characters inside a token, so a text may be cut before each run of
white space that follows another character and the parts encoded by themselves. Each worker keeps
the ids of parts it has met in a table of bounded size; the library encodes what is not in it.

Null texts count as empty and give no ids. Rows are independent, so repeated rows, ties and null
ids come back as they are, one row each; columns not named by the caller are not returned.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from tickloom.llm.common import pieces

#: Parts whose ids a worker keeps, in each of two generations.
KEPT_PARTS = 300_000
#: Characters that ``\s`` means in the pattern (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_SET = frozenset(WHITE)
PARTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point every Unicode version knows the same letters and numbers.
UNSETTLED = re.compile("[^\\0-\u024f]").search


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file: ``json`` of the tokenizers library, or ``ranks`` as base64 and number a line.

    With ``special``, added tokens that stand in a text get their own ids, as the library does by
    default; else they are ordinary text.
    """

    path: str
    kind: str = "json"
    special: bool = False


def alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in printable}
    hidden = (b for b in range(256) if b not in shown)
    shown |= {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def from_ranks(path: str) -> Tokenizer:
    """A tokenizer whose merges are all splits of a token into two others, in rank order."""
    ranks = read_ranks(path)
    shown = alphabet()

    def text(token: bytes) -> str:
        return "".join(shown[b] for b in token)

    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
        known = [c for c in cuts if c[0] in ranks and c[1] in ranks]
        merges += sorted(known, key=lambda c: (ranks[c[0]], ranks[c[1]]))
    vocabulary = {text(token): rank for token, rank in ranks.items()}
    out = Tokenizer(models.BPE(vocabulary, [(text(a), text(b)) for a, b in merges], ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return out


class Irregular(Exception):
    """A part that begins or ends in white space, so that the text needs the general cut."""


class Parts(dict):
    """Ids of parts as little-endian bytes.

    The key is the part itself if it is other characters after a line feed, without the space if
    they follow one space, after a space if they begin the text, and after two spaces for any
    other part. Keys of the first three kinds alone mean that the simple cut of a text was right.
    """

    def __init__(self, tokenizer: Tokenizer, code: str, limit: int) -> None:
        super().__init__()
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.cut = regex.compile(PATTERN).findall
        self.shown = dict(enumerate(alphabet()))
        self.code, self.limit, self.old = code, limit, {}

    def general(self, part: str) -> bytes:
        """Ids of any part of a text."""
        if part[0] not in WHITE_SET:
            return self[" " + part]
        if part[0] == " " and part[1:2] and part[1] not in WHITE_SET:
            return self[part[1:]]
        return self["  " + part]

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.learn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def learn(self, key: str) -> bytes:
        if key.isalpha() and not UNSETTLED(key):
            # Letters after one space are one match of the pattern, by what letters are in every version.
            shown = key if key.isascii() else key.encode().decode("latin-1").translate(self.shown)
            return array(self.code, [t.id for t in self.tokenize("\u0120" + shown)]).tobytes()
        if key[:2] == "  ":
            part = key[2:]
        else:
            body = key.lstrip("\n") if key[:1] == "\n" else key.removeprefix(" ")
            if not body or body[0] in WHITE_SET or body[-1] in WHITE_SET or key[:2] == "\n\n":
                raise Irregular
            part = key if key[0] == "\n" else body if key[0] == " " else " " + key
        if UNSETTLED(part):
            return array(self.code, self.encode(part, add_special_tokens=False).ids).tobytes()
        found = self.cut(part)
        if len(found) > 1:
            return b"".join(map(self.general, found))
        if part.isascii() and part.isprintable():
            shown = part.replace(" ", "\u0120")
        else:
            shown = part.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()


class Encoder:
    """Texts to ids, as bytes of ``dtype`` (16 bits where the vocabulary allows)."""

    def __init__(self, vocabulary: Vocabulary, limit: int = KEPT_PARTS) -> None:
        made = from_ranks(vocabulary.path) if vocabulary.kind == "ranks" else Tokenizer.from_file(vocabulary.path)
        made.encode_special_tokens = not vocabulary.special
        self.tokenizer = made
        self.added = [t.content for t in made.get_added_tokens_decoder().values()] if vocabulary.special else []
        self.size = made.get_vocab_size(with_added_tokens=True)
        self.code, self.dtype = ("H", "<u2") if self.size <= 1 << 16 else ("I", "<u4")
        before = made.pre_tokenizer
        plain = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        self.cuttable = plain and made.normalizer is None
        self.parts = Parts(made, self.code, limit)

    def encode(self, text: str) -> bytes:
        """Ids of one whole text."""
        if not text:
            return b""
        if not self.cuttable or any(token in text for token in self.added):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        cut = text.replace("\n", " \n").split(" ")
        cut[0] = " " + cut[0]
        try:
            return b"".join(map(self.parts.__getitem__, cut))
        except Irregular:
            return b"".join(map(self.parts.general, PARTS.findall(text)))


class Decoder:
    """Ids to bytes, from a table of the bytes of all tokens end to end; needs no merges."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        if vocabulary.kind == "ranks":
            tokens = {i: token for token, i in read_ranks(vocabulary.path).items()}
        else:
            with open(vocabulary.path, encoding="utf-8") as file:
                told = json.load(file)
            back = {c: b for b, c in enumerate(alphabet())}
            tokens = {i: bytes(back[c] for c in shown) for shown, i in told["model"]["vocab"].items()}
            tokens |= {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.flat = np.frombuffer(b"".join(listed), np.uint8)
        self.ends = np.cumsum([0, *map(len, listed)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; cutting ids inside a character gives part of its bytes."""
        flat, ends = self.flat, self.ends
        begin, length = ends[:-1][ids], np.diff(ends)[ids]
        if not len(ids):
            return b""
        stop = np.cumsum(length)
        where = np.arange(stop[-1]) + np.repeat(begin - (stop - length), length)
        return flat[where].tobytes()

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last."""
        lengths = np.diff(self.ends)[ids]
        stop = np.cumsum(lengths)
        character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        return character[stop - lengths], character[stop - 1] + 1

    def text_of_tokens(self, ids: np.ndarray) -> list[str]:
        """Text that each token completes: a split character comes with the token that ends it."""
        flat, ends = self.flat, self.ends
        reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
        out = [reader.decode(flat[ends[i] : ends[i + 1]].tobytes()) for i in ids]
        if out:
            out[-1] += reader.decode(b"", final=True)
        return out


@lru_cache(maxsize=4)
def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of a vocabulary."""
    return Encoder(vocabulary)


@lru_cache(maxsize=4)
def decoder(vocabulary: Vocabulary) -> Decoder:
    """The worker's decoder of a vocabulary."""
    return Decoder(vocabulary)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32), kind))


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """``id_col`` and ``ids``; with ``offsets`` also ``starts`` and ``stops``, in characters of the text.

    With ``decoded`` also the bytes that the ids decode to, by the same task.
    """
    source = docs.select(docs[id_col], docs[text_col].cast("string").alias("text"))
    columns = [source.schema[0], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "stops")]]
    extra = [T.StructField("decoded", T.BinaryType())] if decoded else []
    schema = T.StructType([*(columns if offsets else columns[:2]), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(vocabulary)
        for batch in pieces(batches, "text"):
            texts = [x or "" for x in batch["text"].to_pylist()]
            ids = [np.frombuffer(use.encode(x), use.dtype) for x in texts]
            made = [batch[0], lists(ids, pa.int32())]
            if offsets:
                spans = [decoder(vocabulary).spans(x.encode(), i) for x, i in zip(texts, ids, strict=True)]
                made += [lists([s[k] for s in spans], pa.int32()) for k in (0, 1)]
            if decoded:
                made.append(pa.array([decoder(vocabulary).decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The other columns and ``to``: the bytes of the ids, null ids as empty.

    Bytes are exact also where the ids begin or end inside a character; cast to string where they
    are whole texts.
    """
    rest = [c for c in df.columns if c not in (ids_col, to)]
    source = df.select(*[df[f"`{c}`"] for c in rest], df[ids_col].alias("__ids"))
    schema = T.StructType([*source.schema[:-1], T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = decoder(vocabulary)
        for batch in batches:
            column = batch["__ids"]
            for begin in range(0, batch.num_rows, 256):
                some = column.slice(begin, 256)
                texts = [use.decode(np.asarray(x.values)) if x.is_valid else b"" for x in some]
                made = [batch[c].slice(begin, 256) for c in rest]
                yield pa.RecordBatch.from_arrays([*made, pa.array(texts, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)
