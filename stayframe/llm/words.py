"""Words, word hashes and word windows of a batch of texts, as numpy arrays over the batch's bytes.

Texts stay UTF-8 bytes throughout; a block is a run of consecutive texts whose arrays fit in little memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 2 << 20
#: Longer spans are hashed with XXH3, and compared, one by one.
LONG_SPAN = 64

_EVERY_BYTE = np.arange(256)
_CASELESS = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of words made of ASCII letters, digits and all characters beyond ASCII.
ALPHANUMERIC = (
    ((_EVERY_BYTE >= 48) & (_EVERY_BYTE <= 57)) | ((_CASELESS >= 97) & (_CASELESS <= 122)) | (_EVERY_BYTE >= 128)
)
#: Bytes of words that end at ASCII white space only.
NOT_SPACE = ~((_EVERY_BYTE == 32) | ((_EVERY_BYTE >= 9) & (_EVERY_BYTE <= 13)))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (a bijection)."""
    values = values + _ODD
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


@dataclass(frozen=True)
class Texts:
    """Consecutive texts of a batch: ``data[bounds[i]:bounds[i + 1]]`` is text ``first + i``; null texts are empty."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Cut a binary column into blocks of about ``block_bytes``; a longer text is a block of its own."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(bounds, bounds[start] + block_bytes, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield Texts(start, everything[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start])
        start = end


@dataclass(frozen=True)
class Words:
    """``data[starts[j]:ends[j]]`` is word ``j``; those of text ``i`` are ``bounds[i]`` to ``bounds[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def find_words(texts: Texts, word_bytes: np.ndarray) -> Words:
    """Maximal runs of word bytes. A run ends with its text."""
    inside = word_bytes[texts.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    n = len(texts.data)
    cuts = texts.bounds[:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    ends = texts.bounds[1:] - 1
    ends = ends[ends >= 0]
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, texts.bounds))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


#: What of a lane belongs to a span that has so many bytes left.
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, caseless: bool = False) -> np.ndarray:
    """A 64-bit hash of every span's bytes; ASCII case is ignored if ``caseless``.

    Eight bytes at a time are taken in and mixed; XXH3 takes spans over :data:`LONG_SPAN` bytes.
    """
    if caseless:
        data = _CASELESS[data]
    lanes = _lanes(data)
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64))
    own = np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN))
    at, left = starts[own], lengths[own]
    while len(own):
        out[own] = mixed(out[own] ^ (lanes[at] & _LANE_MASK[np.minimum(left, 8)]))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(lengths > LONG_SPAN)
    if len(long):
        digest, content = xxhash.xxh3_64_intdigest, data.tobytes()
        for i, start, end in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            out[i] = digest(content[start:end])
    return out


def equal_spans(data: np.ndarray, spans: np.ndarray, others: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether span ``spans[i]`` has the bytes of span ``others[i]``, for every i."""
    lanes = _lanes(data)
    lengths = ends[spans] - starts[spans]
    equal = lengths == ends[others] - starts[others]
    own = np.flatnonzero(equal & (lengths > 0) & (lengths <= LONG_SPAN) & (spans != others))
    one, other, left = starts[spans[own]], starts[others[own]], lengths[own]
    while len(own):
        same = (lanes[one] ^ lanes[other]) & _LANE_MASK[np.minimum(left, 8)] == 0
        equal[own[~same]] = False
        more = same & (left > 8)
        own, one, other, left = own[more], one[more] + 8, other[more] + 8, left[more] - 8
    long = np.flatnonzero(equal & (lengths > LONG_SPAN) & (spans != others))
    if len(long):
        content = data.tobytes()
        pairs = zip(starts[spans[long]].tolist(), starts[others[long]].tolist(), lengths[long].tolist(), strict=True)
        equal[long] = [content[a : a + n] == content[b : b + n] for a, b, n in pairs]
    return equal


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of every distinct byte string, the number of every span's string). Equal hashes are checked on the bytes."""
    hashes = span_hashes(data, starts, ends)
    order = np.argsort(hashes)
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    first = order[new]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    every = np.arange(len(starts))
    if equal_spans(data, every, first[number], starts, ends).all():
        return first, number
    content = data.tobytes()
    numbers: dict[bytes, int] = {}
    spans = (content[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    number = np.fromiter((numbers.setdefault(span, len(numbers)) for span in spans), dtype=np.int64, count=len(starts))
    _, first = np.unique(number, return_index=True)
    return first, number


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes, windows that cross texts included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out *= _ODD
        out += hashes[i : i + n]
    return mixed(out)


def whole_windows(words: Words, size: int) -> np.ndarray:
    """Starts of the windows of ``size`` words that lie in one text."""
    inside = np.arange(max(len(words.starts) - size + 1, 0))
    ends = np.repeat(words.bounds[1:], words.counts())[: len(inside)]
    return inside[inside + size <= ends]


def keyed_by_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Make equal hashes of different texts differ."""
    return mixed(hashes ^ mixed(text.astype(np.uint64)))


def summed_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for every i, empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``size`` from any of ``starts``."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:n]) > 0
