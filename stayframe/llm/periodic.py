"""Periodic runs of words: maximal stretches whose words repeat at least three times over.

Every run is found from the Lyndon roots of its text: under one of the two orders of words, the longest Lyndon word that
starts in the run's first periods is as long as the period. So the longest Lyndon word of every place, under both orders,
is a candidate; it is extended to the right with the suffix tree of the text, to the left with that of its reversal.

Trees are built for the stretches that can hold a run at all. A run of at least 24 words and three periods consists of
16-word windows that stand in it twice, so words that no repeated window covers are in no run, and a run never
reaches beyond a stretch of covered words. That is a property of runs, not a limit: every run is found, in texts of any
length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.llm.suffixtree import Extensions
from stayframe.llm.words import NOT_SPACE, Texts, Words, covered, find_words, keyed_by_text, span_hashes, text_blocks, whole_windows, window_hashes

#: A run has at least so many words, and so many times its period.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Stretches are put together up to so many words for one pair of trees; a longer one has its own.
TREE_WORDS = 1 << 16


def shared_window(least_words: int, least_periods: int) -> int:
    """The longest window that every run holds twice, one period apart."""
    return min(max(least_words - q, (least_periods - 1) * q) for q in range(1, least_words + 1))


@dataclass(frozen=True)
class Runs:
    """Run i covers ``length[i]`` words from word ``start[i]`` on, and repeats after ``period[i]``."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _next_smaller(ranks: list[int]) -> list[int]:
    """For every place the next one with a smaller value; the length of the list, if there is none."""
    n = len(ranks)
    out = [n] * n
    waiting: list[int] = []
    for at, rank in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > rank:
            out[waiting.pop()] = at
        waiting.append(at)
    return out


def sequence_runs(symbols: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Runs:
    """All runs of a sequence of symbols from 1 on, in no order. No run has more than ``longest`` symbols."""
    n = len(symbols)
    width = int(symbols.max(initial=0)) + 1
    forward = Extensions([*symbols.tolist(), 0], width)
    ranks = forward.ranks()[:n]
    places = np.arange(n)
    # A suffix is followed by a smaller one where its longest Lyndon word ends; once for each order of symbols.
    periods = np.stack([np.asarray(_next_smaller(order.tolist()), dtype=np.int64) - places for order in (ranks, -ranks)])
    wanted = (places + periods < n) & (least_periods * periods <= longest)
    at = np.broadcast_to(places, periods.shape)[wanted]
    period = periods[wanted]
    right = forward.common(at, at + period)
    del forward
    # A root that starts in its run's first period is followed by all periods but two, and some.
    enough = right > (least_periods - 2) * period
    at, period, right = at[enough], period[enough], right[enough]
    left = np.zeros(len(at), dtype=np.int64)
    inner = at > 0
    if inner.any():
        backward = Extensions([*symbols[::-1].tolist(), 0], width)
        left[inner] = backward.common(n - at[inner], n - at[inner] - period[inner])
    length = left + period + right
    good = (length >= least_words) & (length >= least_periods * period)
    found = np.unique(np.stack([at[good] - left[good], length[good], period[good]], axis=1), axis=0)
    return Runs(found[:, 0], found[:, 1], found[:, 2])


def _stretches(texts: Texts, words: Words, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold runs; none crosses texts."""
    size = shared_window(least_words, least_periods)
    hashes = window_hashes(span_hashes(texts.data, words.starts, words.ends), size)
    places = whole_windows(words, size)
    n = len(words.starts)
    bounds = words.bounds
    found = bounds[:-1], bounds[1:]
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = words.text_of()
    keys = keyed_by_text(hashes[places], text[places])
    order = np.argsort(keys, kind="stable")
    again = keys[order][:-1] == keys[order][1:]
    first, later = places[order[:-1][again]], places[order[1:][again]]
    # A window comes again within one period, so within a third of the stretch that a run would be in.
    stretch = text[first]
    while True:
        lengths = (found[1] - found[0])[stretch]
        near = (lengths >= least_words) & (least_periods * (later - first) <= lengths) & (later + size <= found[1][stretch])
        first, later = first[near], later[near]
        inside = covered(np.concatenate([first, later]), size, n)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[bounds[:-1][bounds[:-1] < n]] = inside[bounds[:-1][bounds[:-1] < n]]
        starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | begins[1:]
        ends = np.flatnonzero(stops) + 1
        if near.all() and len(starts) == len(found[0]) and (starts == found[0]).all() and (ends == found[1]).all():
            break
        found = starts, ends
        stretch = np.searchsorted(starts, first, side="right") - 1
    long = ends - starts >= least_words
    return starts[long], ends[long]


def _joined(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Neighbouring stretches of about :data:`TREE_WORDS` words together."""
    at = words = 0
    lengths = (ends - starts).tolist()
    for k, length in enumerate(lengths):
        if words and words + length > TREE_WORDS:
            yield slice(at, k)
            at, words = k, 0
        words += length
    if words:
        yield slice(at, len(lengths))


def block_runs(texts: Texts, words: Words, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Runs:
    """All runs of every text of a block, by start, then period. Starts count the words of the block."""
    starts, ends = _stretches(texts, words, least_words, least_periods)
    data = texts.data.tobytes()
    parts = [np.zeros((0, 3), dtype=np.int64)]
    for own in _joined(starts, ends):
        lengths = ends[own] - starts[own]
        begins = np.cumsum(lengths + 1) - lengths - 1
        before = np.cumsum(lengths) - lengths
        word = np.arange(int(lengths.sum())) + np.repeat(starts[own] - before, lengths)
        # After each stretch stands a symbol of its own, smaller than all words, which no run can hold.
        symbols = np.zeros(int(begins[-1] + lengths[-1] + 1), dtype=np.int64)
        numbers: dict[bytes, int] = {}
        spans = zip(words.starts[word].tolist(), words.ends[word].tolist(), strict=True)
        symbol = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in spans], dtype=np.int64)
        filled = np.ones(len(symbols), dtype=bool)
        filled[begins + lengths] = False
        symbols[filled] = symbol + 1 + len(lengths)
        symbols[~filled] = np.arange(len(lengths)) + 1
        found = sequence_runs(symbols, int(lengths.max()), least_words, least_periods)
        of = np.searchsorted(begins, found.start, side="right") - 1
        parts.append(np.stack([found.start - begins[of] + starts[own][of], found.length, found.period], axis=1))
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return Runs(rows[:, 0], rows[:, 1], rows[:, 2])


def _collapsed(texts: Texts, words: Words, runs: Runs) -> list[bytes]:
    """The words of every text, joined by a space, without those that stand in a run after its first period."""
    change = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    starts, ends = words.starts[kept], words.ends[kept]
    bounds = np.searchsorted(kept, words.bounds).tolist()
    data = texts.data.tobytes()
    pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [b" ".join(pieces[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, ``n_words``, ``runs`` (array of start, length and period, by start, then period) and ``collapsed`` of every row.

    Words end at ASCII white space and are compared byte by byte. A run is a maximal stretch with its smallest period; it
    has ``least_words`` words and ``least_periods`` periods or more. ``collapsed`` has the words that stand in no run or in
    the first period of each of theirs. A null or empty text has no words, no runs, and an empty ``collapsed``. Rows are
    neither merged nor dropped, repeated and null doc_ids included; other columns are ignored.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = find_words(texts, NOT_SPACE)
                runs = block_runs(texts, words, least_words, least_periods)
                first = words.bounds[:-1]
                at = np.searchsorted(runs.start, words.bounds).astype(np.int32)
                of = np.searchsorted(words.bounds, runs.start, side="right") - 1
                values = [pa.array(v) for v in (runs.start - first[of], runs.length, runs.period)]
                lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(values, fields=list(run)))
                arrays = [
                    batch.column(0).slice(texts.first, len(texts)),
                    pa.array(words.counts().astype(np.int64)),
                    lists,
                    pa.array(_collapsed(texts, words, runs), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(
        per_batch, f"doc_id {key_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )
    return found.withColumn("collapsed", F.decode("collapsed", "UTF-8"))
