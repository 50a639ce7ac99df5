"""Variable-capacity best-fit packing of documents into training sequences.

Pieces of one length are interchangeable, so packing is planned on the histogram of lengths, whose size is bounded by the
longest sequence and not by the rows. The plan is a best-fit-decreasing packing of the whole corpus: groups of bins with
equal contents, each with how many pieces of which lengths it takes. Pieces then find their bin by their rank among the
pieces of their length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.llm.stored import stored
from stayframe.llm.tokens import BLOCK_BYTES, END_ID, SequenceFormat, encoder
from stayframe.llm.words import text_blocks
from stayframe.operators.numbering import number_within

#: Permitted sequence lengths, in tokens.
CAPACITIES = (2048, 4096, 8192, 16384)
#: While ids are kept along, blocks and the memory of known pieces are small, as they are beside what earlier work left in a worker.
KEPT_BLOCK_BYTES, KEPT_REMEMBERED = 1 << 20, 150_000
#: What a sequence costs besides its tokens, and the length at which attention costs as much as everything else.
SEQUENCE_COST, ATTENTION_LENGTH = 64, 16384


def sequence_cost(capacity: int) -> float:
    return SEQUENCE_COST + capacity + capacity * capacity / ATTENTION_LENGTH


@dataclass(frozen=True)
class Content:
    """``per_bin`` pieces of one length in every bin of a group, from the piece with rank ``first_rank`` on."""

    length: int
    per_bin: int
    first_rank: int

    def later(self, bins: int) -> Content:
        return Content(self.length, self.per_bin, self.first_rank + bins * self.per_bin)


@dataclass(frozen=True)
class BinGroup:
    """``bins`` bins with equal contents; the rest of each is free."""

    bins: int
    free: int
    filled: int
    contents: tuple[Content, ...]

    def split(self, bins: int) -> tuple[BinGroup, BinGroup]:
        later = tuple(content.later(bins) for content in self.contents)
        return BinGroup(bins, self.free, self.filled, self.contents), BinGroup(self.bins - bins, self.free, self.filled, later)

    def with_pieces(self, length: int, per_bin: int, first_rank: int) -> BinGroup:
        used = length * per_bin
        return BinGroup(self.bins, self.free - used, self.filled + used, (*self.contents, Content(length, per_bin, first_rank)))


class _OpenBins:
    """Groups of bins by their free room."""

    def __init__(self):
        self.by_room: dict[int, list[BinGroup]] = defaultdict(list)
        self.rooms: list[int] = []
        self.done: list[BinGroup] = []

    def add(self, group: BinGroup, least: int) -> None:
        """Keep a group open; it is done when it has less room than the shortest piece."""
        if not group.bins:
            return
        if group.free < least:
            self.done.append(group)
            return
        if group.free not in self.by_room:
            insort(self.rooms, group.free)
        self.by_room[group.free].append(group)

    def take_tightest(self, length: int) -> BinGroup | None:
        """Remove and return a group whose room is the smallest that holds ``length``."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            del self.rooms[at]
        return group

    def all(self) -> list[BinGroup]:
        return [*self.done, *(group for room in self.rooms for group in self.by_room[room])]


def _best_fit(histogram: Mapping[int, int], capacities: Sequence[int], preferred: int | None) -> list[BinGroup]:
    """Longest pieces first, each into the open bin it fills best; a new bin is opened when none has room.

    A new bin has the ``preferred`` capacity, or the next one that holds the piece. Without a preference it is the one that
    costs least per token it can expect: its own pieces of this length, and shorter ones as far as there are any.
    """
    least = min(histogram, default=1)
    bins = _OpenBins()
    shorter = sum(length * n for length, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        waiting, rank = histogram[length], 0
        shorter -= length * waiting
        while waiting:
            group = bins.take_tightest(length)
            if group is None:
                fitting = [capacity for capacity in capacities if capacity >= length]
                if preferred is not None:
                    capacity = next((c for c in fitting if c >= preferred), fitting[-1])
                else:

                    def cost_per_token(capacity: int) -> float:
                        own = min(capacity // length, waiting) * length
                        return sequence_cost(capacity) / (own + min(capacity - own, shorter))

                    capacity = min(fitting, key=lambda capacity: (cost_per_token(capacity), capacity))
                group = BinGroup(math.ceil(waiting / (capacity // length)), capacity, 0, ())
            per_bin = group.free // length
            full = min(group.bins, waiting // per_bin)
            taken, rest = group.split(full)
            if full:
                bins.add(taken.with_pieces(length, per_bin, rank), least)
                rank, waiting = rank + full * per_bin, waiting - full * per_bin
            if waiting and rest.bins:
                last, rest = rest.split(1)
                bins.add(last.with_pieces(length, waiting, rank), least)
                waiting = 0
            bins.add(rest, least)
    return bins.all()


def downsized(group: BinGroup, capacities: Sequence[int]) -> int:
    """The shortest permitted length that holds a bin's contents."""
    return next(capacity for capacity in sorted(capacities) if capacity >= group.filled)


@dataclass(frozen=True)
class PackingPlan:
    """Per length, in ascending order of length and first rank, where runs of ranks go."""

    length: np.ndarray
    first_rank: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    first_bin: np.ndarray
    capacity: np.ndarray
    cost: float

    @classmethod
    def of(cls, histogram: Mapping[int, int], capacities: Sequence[int] = CAPACITIES) -> PackingPlan:
        """The cheapest of the packings with each capacity preferred for new bins, and with none."""
        capacities = sorted(capacities)
        packings = [_best_fit(histogram, capacities, preferred) for preferred in (None, *capacities)]

        def cost(groups: list[BinGroup]) -> float:
            return sum(group.bins * sequence_cost(downsized(group, capacities)) for group in groups)

        best = min(packings, key=cost)
        rows, first_bin = [], 0
        for group in best:
            capacity, offset = downsized(group, capacities), 0
            for content in group.contents:
                rows.append((content.length, content.first_rank, content.per_bin, offset, first_bin, capacity))
                offset += content.length * content.per_bin
            first_bin += group.bins
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
        return cls(*table.T, cost=cost(best))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, capacity and offset in the bin of the pieces with these lengths and ranks (from 0)."""
        widest = np.int64(1) << np.int64(40)
        at = np.searchsorted(self.length * widest + self.first_rank, length * widest + rank, side="right") - 1
        beyond = rank - self.first_rank[at]
        offset = self.offset[at] + beyond % self.per_bin[at] * length
        return self.first_bin[at] + beyond // self.per_bin[at], self.capacity[at], offset


def _cut(longest: int) -> Column:
    """The pieces of a document of ``total`` tokens, as numbers from 0."""
    return F.sequence(F.lit(0), F.floor((F.col("total") - 1) / longest).cast("int"))


def pieces(docs: DataFrame, longest: int, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """row, doc_id, piece, ``start`` and ``n_tokens`` of the pieces of every row's whole ``text``; with ``ids``, if wanted.

    Tokens are the ids of a tokenizers file, or UTF-8 bytes without one; each document has an end id besides. A null text
    has the end id alone. A document longer than the longest sequence is cut into pieces of that length and a rest.
    ``row`` tells rows apart; store the frame before it is used twice.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    key_type = docs.schema["doc_id"].dataType.simpleString()
    start = F.col("piece").cast("long") * longest
    columns = ["row", "doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("total") - start).cast("long").alias("n_tokens")]
    if tokenizer is None and not with_ids:
        total = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
        counted = keyed.select("row", "doc_id", total.cast("long").alias("total"))
        return counted.withColumn("piece", F.explode(_cut(longest))).select(*columns)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, SequenceFormat().id_type, KEPT_REMEMBERED if with_ids else None) if tokenizer is not None else None
        for batch in batches:
            for texts in text_blocks(batch.column(2), KEPT_BLOCK_BYTES if with_ids else BLOCK_BYTES):
                part = batch.slice(texts.first, len(texts))
                if not with_ids:
                    totals = own.count(texts) + 1
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(totals)], ["row", "doc_id", "total"])
                    continue
                if own is not None:
                    ids = [np.append(found, np.uint16(END_ID)).tobytes() for found in own.encode(texts)]
                else:
                    # A byte is its own id, shifted past the end id.
                    spans = zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True)
                    ids = [np.append(texts.data[a:b].astype(np.uint16) + np.uint16(END_ID + 1), np.uint16(END_ID)).tobytes() for a, b in spans]
                totals = np.array([len(found) // 2 for found in ids], dtype=np.int64)
                arrays = [part.column(0), part.column(1), pa.array(totals), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "total", "ids"])

    schema = f"row long, doc_id {key_type}, total long" + (", ids binary" if with_ids else "")
    cut = keyed.mapInArrow(per_batch, schema).withColumn("piece", F.explode(_cut(longest)))
    if with_ids:
        columns.append(F.substring("ids", F.col("piece") * (2 * longest) + 1, F.lit(2 * longest)).alias("ids"))
    return cut.select(*columns)


def _placed(ranked: DataFrame, plan: Broadcast[PackingPlan]) -> DataFrame:
    names = ("row", "doc_id", "piece", "start", "n_tokens")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("n_tokens", "rank"))
            found = plan.value.place(length, rank.astype(np.int64) - 1)
            columns = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], [*names, "bin", "capacity", "offset"])

    key_type = ranked.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {key_type}, piece int, start long, n_tokens long, bin long, capacity long, offset long"
    return ranked.select(*names, "rank").mapInArrow(per_batch, schema)


def _packed(cut: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """The bin and place of every piece of a stored table of pieces."""
    lengths = cut.select("row", "doc_id", "piece", "start", "n_tokens")
    histogram = {row["n_tokens"]: row["count"] for row in lengths.groupBy("n_tokens").count().collect()}
    plan = cut.sparkSession.sparkContext.broadcast(PackingPlan.of(histogram, capacities))
    # The row comes last, so that not even equal rows without a key are one group that cannot be parted.
    return _placed(number_within(lengths, ["n_tokens"], ["doc_id", "piece", "row"], "rank"), plan)


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, tokenizer: str | None = None) -> DataFrame:
    """Pack every row of ``docs``: doc_id, piece, start, n_tokens, ``bin``, ``capacity`` and ``offset`` of every piece.

    Lengths are in ids of the ``tokenizer`` (path of a tokenizers file), or in UTF-8 bytes without one; the end id counts.
    ``start`` is the piece's place in its document, ``offset`` in its bin; bins count from 0 without gaps. Repeated rows
    are packed each, whatever their keys. Columns other than doc_id and text are not read. No documents give no rows.
    """
    cut = stored(pieces(docs, max(capacities), tokenizer), "pieces")
    return _packed(cut, capacities).drop("row")


def pack_sequences(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, tokenizer: str | None = None) -> DataFrame:
    """Training sequences of ``docs``: one row per bin, with its ids.

    ``bin``, ``capacity``, ``n_tokens`` (the rest is padding: ``ids[:n_tokens]`` count), ``ids`` (array of ``capacity``
    ints, padded with the end id), and of every piece in it, in order: ``doc_ids``, ``pieces`` and ``starts``. So ``starts``
    are the segment starts that attention must not look across. Rows as for :func:`pack`.
    """
    cut = stored(pieces(docs, max(capacities), tokenizer, with_ids=True), "token-pieces")
    places = stored(_packed(cut, capacities), "token-places").select("row", "piece", "bin", "capacity", "offset")
    placed = cut.select("row", "piece", "doc_id", "n_tokens", "ids").join(places, ["row", "piece"])
    content = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "n_tokens", "ids")))
    # A bin holds at most the longest sequence.
    bins = placed.groupBy("bin", "capacity").agg(content.alias("content"))
    key_type = docs.schema["doc_id"].dataType.simpleString()
    # A field of an array of structs is the array of the fields.
    joined = bins.select("bin", "capacity", *[F.col(f"content.{name}").alias(name) for name in ("doc_id", "piece", "offset", "ids")])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capacity = batch.column(1).to_numpy()
            whole = np.full(int(capacity.sum()), END_ID, dtype=np.int32)
            ends = np.cumsum(capacity)
            totals = np.empty(len(capacity), dtype=np.int64)
            for i, parts in enumerate(batch.column(5).to_pylist()):
                own = np.frombuffer(b"".join(parts), dtype=np.uint16)
                totals[i] = len(own)
                whole[ends[i] - capacity[i] : ends[i] - capacity[i] + len(own)] = own
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(whole))
            arrays = [batch.column(0), batch.column(1), pa.array(totals), ids, batch.column(2), batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, ["bin", "capacity", "n_tokens", "ids", "doc_ids", "pieces", "starts"])

    return joined.mapInArrow(
        per_batch,
        f"bin long, capacity long, n_tokens long, ids array<int>, doc_ids array<{key_type}>, pieces array<int>, starts array<long>",
    )
