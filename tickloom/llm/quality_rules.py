"""Quality by compression bands.

A whole text is compressed with zstandard, and so are its fixed chunks; the ratio of plain to
compressed bytes is high for repetitive text and near one for text that cannot be compressed. A
text passes if its ratio lies in the band for its length and at most half of its chunks lie
outside the bands for theirs. Short texts compress less, so the bands rise with length.

``fitted`` makes the bands from labelled prose. In each language it takes the median ratio of the
rows nearest to each half power of two of bytes, and the spread around it (1.4826 times the median
deviation, slope removed). The upper limit is ``SPREADS`` spreads above the median, in the language
where that is most; ``SPREADS`` is the least multiple of a half that loses at most one in two hundred
good rows of every language. The lower limit is ``LEAST_SHARE`` of the least median: prose of other
corpora may compress less, encoded data compresses less still. ``BANDS`` is the fit on the good
labelled rows of sf0.1; between its sizes the limits are interpolated, below them they stay, and
above them the upper limit grows by ``GROWTH`` for each doubling while the lower one stays.

Before that come plain counts: words ``[^\\x20\\x09-\\x0D]+``, code points in words, characters of
``[#*$%&|<>]``, lines with a word that equal an earlier line, and words in windows of three words
found twice or more. Under 50 words, or over half the words in repeated windows, fails.

Null texts count as empty and fail for want of words. Rows are judged by themselves, so null ids,
ties and repeated rows come back one row each. ``keep`` returns all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tickloom.llm.common import byte_texts, pieces

#: Least words, and most words in repeated windows in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Powers of two of bytes, from the first by halves, with least and most ratio.
FIRST_POWER = 8.0
BANDS = (
    (1.274, 1.747), (1.274, 1.747), (1.274, 1.763), (1.431, 1.901), (1.542, 2.008),
    (1.618, 2.103), (1.697, 2.172), (1.771, 2.206), (1.825, 2.292), (1.869, 2.358),
    (1.906, 2.409),
)
SPREADS, LEAST_SHARE, GROWTH, NEAREST = 3.5, 0.85, 0.12, 60
CHUNK, MOST_ODD_CHUNKS = 4096, 0.5
LEVEL = 3
#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, odd_chunks long, chunks long"
)


@lru_cache(maxsize=1)
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


def ratio(data: bytes | memoryview) -> float:
    return len(data) / len(compressor().compress(data))


def band(size: int) -> tuple[float, float]:
    """Least and most ratio of prose of so many bytes."""
    place = 2 * (log2(max(size, 1)) - FIRST_POWER)
    last = len(BANDS) - 1
    if place >= last:
        return BANDS[last][0], BANDS[last][1] + GROWTH * (place - last) / 2
    i = int(max(place, 0))
    part = max(place, 0) - i
    return tuple(a + (b - a) * part for a, b in zip(BANDS[i], BANDS[i + 1]))


def in_band(data: bytes | memoryview, found: float) -> bool:
    least, most = band(len(data))
    return least <= found <= most


def fitted(sizes: np.ndarray, ratios: np.ndarray, langs: np.ndarray) -> list[tuple[float, float]]:
    """``BANDS`` for bytes, ratios and languages of good rows; a language needs ``NEAREST`` rows."""
    powers = FIRST_POWER + np.arange(len(BANDS)) / 2
    low, high = [], []
    for lang in np.unique(langs):
        x, y = np.log2(sizes[langs == lang]), ratios[langs == lang]
        if len(x) < NEAREST:
            continue
        near = [np.argsort(abs(x - p), kind="stable")[: max(NEAREST, (abs(x - p) <= 0.25).sum())] for p in powers]
        middle = np.array([np.median(y[rows]) for rows in near])
        for _ in range(3):
            left = y - np.interp(x, powers, middle)
            middle += [np.median(left[rows]) for rows in near]
        left = y - np.interp(x, powers, middle)
        spread = np.array([1.4826 * np.median(abs(left[rows] - np.median(left[rows]))) for rows in near])
        low.append(LEAST_SHARE * middle)
        high.append(middle + SPREADS * spread)
    return list(zip(np.min(low, 0).round(3).tolist(), np.max(high, 0).round(3).tolist(), strict=True))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def chunk_cuts(size: int) -> list[tuple[int, int]]:
    """Chunks of a text; a rest of under half a chunk belongs to the one before."""
    cuts = [*range(0, max(size - CHUNK // 2, 1), CHUNK), size]
    return list(zip(cuts, cuts[1:]))


def judged(text: bytes) -> tuple:
    """The measures of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
    whole, odd, cuts = None, 0, []
    if text:
        whole = ratio(text)
        view = memoryview(text)
        cuts = chunk_cuts(len(text)) if len(text) > CHUNK else []
        odd = sum(not in_band(view[a:b], ratio(view[a:b])) for a, b in cuts)
    fits = whole is not None and in_band(text, whole) and odd <= MOST_ODD_CHUNKS * len(cuts)
    return (
        len(words),
        len(text.translate(None, NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        fits and not failed,
        whole,
        odd,
        len(cuts),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measures, one row per row."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([source.schema[0], *T._parse_datatype_string(MEASURES)])
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = map(judged, byte_texts(batch["text"]))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            yield batch.filter(pa.array([judged(x)[6] for x in byte_texts(batch[text_col])]))

    return docs.mapInArrow(run, docs.schema)
