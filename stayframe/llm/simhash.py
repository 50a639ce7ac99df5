"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most ``distance`` bits agree fully in at least ``blocks - distance`` of ``blocks`` blocks of
bits. Every choice of such blocks is a mask, and the fingerprints that share the masked bits hang below one upper node
of the index: a search enters that node without a difference so far, and no other node of that mask. Nodes are spread over
the cluster. Below each, the fingerprints are sorted by their rank in the Gray code, so that neighbours share bits, and
runs of neighbours are factored into inner nodes that hold the bits common to all of them. A search adds up the
differences in the bits each level settles, and leaves a whole run as soon as they exceed ``distance``.

A node with too many fingerprints is not searched: the bits its mask leaves free are cut into blocks again, and its
fingerprints move down to nodes with longer masks. Distinct fingerprints part in the end, so every link is found and no
task gets a node beyond the limit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.llm.components import connected
from stayframe.llm.stored import stored, unused_names
from stayframe.llm.words import NOT_SPACE, find_words, text_blocks

BITS = 64
SHINGLE_WORDS = 4
DISTANCE = 4
#: Blocks per level of masks; ``BLOCKS - DISTANCE`` of them agree.
BLOCKS = 6
#: A node with more distinct fingerprints is split into longer masks. Ten billion of them fill nodes to about 4,800.
NODE_LIMIT = 8192
#: Children per inner node.
FAN_OUT = 8
#: Searches that walk the index together.
TOGETHER = 256


def _fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    bits = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def text_fingerprints(column: pa.Array, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of every text of a binary column; 0 for a text without words."""
    out = np.zeros(len(column), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for texts in text_blocks(column):
        words = find_words(texts, NOT_SPACE)
        data = texts.data.tobytes().lower()
        for i, (first, end) in enumerate(itertools.pairwise(words.bounds.tolist())):
            n = end - first
            if not n:
                continue
            own = data[texts.bounds[i] : texts.bounds[i + 1]].split()
            line = b" ".join(own)
            ends = np.cumsum(words.ends[first:end] - words.starts[first:end] + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            size = min(shingle_words, n)
            spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
            hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), dtype=np.uint64, count=n - size + 1)
            out[texts.first + i] = _fingerprint_of(hashes)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and ``fingerprint`` (the 64 bits as a long) of every row's whole ``text``; other columns are ignored.

    Null and empty texts, and texts shorter than a shingle, have a fingerprint too: 0 without words, else that of the
    whole word sequence.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_fingerprints(batch.column(1), shingle_words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        per_batch, f"doc_id {key_type}, fingerprint long"
    )


def hex_digits(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of every code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def masks_below(mask: int, distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """The longer masks below a mask: ``mask`` and any ``blocks - distance`` of the blocks its free bits are cut into."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    if len(free) <= blocks:
        return [mask | ((1 << BITS) - 1)] if not free else [mask | 1 << bit for bit in free]
    cuts = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in free[a:b]) for a, b in itertools.pairwise(cuts)]
    return [mask | sum(chosen) for chosen in itertools.combinations(parts, blocks - distance)]


def _rank(code: str) -> Column:
    """:func:`gray_rank` as a column."""
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


class GrayIndex:
    """Fingerprints in Gray order, and levels of nodes over them that hold the bits all their fingerprints share."""

    def __init__(self, codes: np.ndarray, settled: int = 0):
        """``settled``: bits known to be equal in all codes, which no level looks at again."""
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        known = np.uint64(settled)
        common, value = np.full(len(codes), ~np.uint64(0)), self.codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(common, value)]
        while len(value) > 1:
            starts = np.arange(0, len(value), FAN_OUT)
            all_set = np.bitwise_and.reduceat(common & value, starts)
            all_clear = np.bitwise_and.reduceat(common & ~value, starts)
            common, value = all_set | all_clear, all_set
            self.levels.append((common, value))
        self.levels.reverse()
        # The bits a node settles beyond its parent.
        self.fresh = [self.levels[0][0] & ~known]
        for (above, _), (own, _) in itertools.pairwise(self.levels):
            self.fresh.append(own & ~(np.repeat(above, FAN_OUT)[: len(own)] | known))

    def links(self, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in :attr:`codes`, the earlier one first, that differ in at most ``distance`` bits."""
        for at in range(0, len(self.codes), TOGETHER):
            seeker = np.arange(at, min(at + TOGETHER, len(self.codes)))
            node = np.zeros(len(seeker), dtype=np.int64)
            behind = np.zeros(len(seeker), dtype=np.int64)
            for level, ((_, value), fresh) in enumerate(zip(self.levels, self.fresh, strict=True)):
                if level:
                    seeker, behind = np.repeat(seeker, FAN_OUT), np.repeat(behind, FAN_OUT)
                    node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    there = node < len(value)
                    seeker, node, behind = seeker[there], node[there], behind[there]
                behind = behind + np.bitwise_count((self.codes[seeker] ^ value[node]) & fresh[node])
                near = behind <= distance
                if level == len(self.levels) - 1:
                    near &= node > seeker
                seeker, node, behind = seeker[near], node[near], behind[near]
            yield seeker, node


def representatives(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of everyone's component, from links in portions."""
    root = np.arange(n)
    for left, right in links:
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
    return root


def _node_links(masks: np.ndarray, masked: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole nodes, given as consecutive rows: linked codes and their representatives."""
    n = len(codes)
    changes = np.flatnonzero((masks[1:] != masks[:-1]) | (masked[1:] != masked[:-1])) + 1
    starts, ends = np.concatenate([[0], changes]), np.concatenate([changes, [n]])
    sizes = ends - starts
    left, right = [], []
    # Nodes of one run of children are leaves: their members are compared directly.
    leaf = np.repeat(sizes <= FAN_OUT, sizes)
    node_end = np.repeat(ends, sizes)
    for step in range(1, FAN_OUT):
        at = np.flatnonzero(leaf[: n - step] & (np.arange(n - step) + step < node_end[: n - step])) if n > step else []
        if not len(at):
            break
        at = at[np.bitwise_count(codes[at] ^ codes[at + step]) <= DISTANCE]
        left.append(codes[at + step])
        right.append(codes[at])
    for k in np.flatnonzero(sizes > FAN_OUT):
        index = GrayIndex(codes[starts[k] : ends[k]], int(masks[starts[k]]) & ((1 << BITS) - 1))
        root = representatives(len(index.codes), index.links())
        linked = np.flatnonzero(root != np.arange(len(root)))
        left.append(index.codes[linked])
        right.append(index.codes[root[linked]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([*left, empty]), np.concatenate([*right, empty])


def _search_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Search the nodes of a partition, whose rows come node by node; only the last node of a batch waits for the next."""
    waiting: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def searched(masks: np.ndarray, masked: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        left, right = _node_links(masks, masked, codes.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], ["a", "b"])

    for batch in batches:
        rows = [np.concatenate([old, new.to_numpy()]) for old, new in zip(waiting, batch.columns, strict=True)]
        if not len(rows[0]):
            continue
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        yield searched(*[column[:cut] for column in rows])
        waiting = [column[cut:] for column in rows]
    if len(waiting[0]):
        yield searched(*waiting)


def _entered(codes: DataFrame, masks: Column) -> DataFrame:
    """Every fingerprint below every node it shares the masked bits of."""
    return codes.select(F.explode(masks).alias("mask"), "fingerprint").withColumn(
        "masked", F.col("fingerprint").bitwiseAND(F.col("mask"))
    )


def _signed(values: list[int]) -> list[int]:
    return [value - (1 << BITS) if value >> (BITS - 1) else value for value in values]


def similar_fingerprints(codes: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within :data:`DISTANCE` bits, directly or in steps.

    ``codes`` has distinct ``fingerprint`` values. Inside a node only a spanning set of its links is returned.
    """
    spark = codes.sparkSession
    found: DataFrame | None = None
    waiting = _entered(codes, F.array(*[F.lit(mask) for mask in _signed(masks_below(0))]))
    while True:
        waiting = stored(waiting, "index-nodes")
        sizes = waiting.groupBy("mask", "masked").agg(F.count("*").alias("n")).where("n > 1")
        large = stored(sizes.where(F.col("n") > node_limit), "large-nodes")
        some_large = bool(large.take(1))
        searched = waiting.join(large, ["mask", "masked"], "left_anti") if some_large else waiting
        by_node = searched.repartition("mask", "masked").sortWithinPartitions("mask", "masked", _rank("fingerprint"))
        links = by_node.select("mask", "masked", "fingerprint").mapInArrow(_search_nodes, "a long, b long")
        links = stored(links.distinct(), "fingerprint-links")
        found = links if found is None else found.unionByName(links)
        if not some_large:
            return found
        # The masks of a level are few; each has its list of longer ones.
        masks = [row["mask"] for row in large.select("mask").distinct().collect()]
        below = spark.createDataFrame(
            [(mask, _signed(masks_below(mask & ((1 << BITS) - 1)))) for mask in masks], "mask long, longer array<long>"
        )
        waiting = _entered(
            waiting.join(large.select("mask", "masked"), ["mask", "masked"], "left_semi").join(F.broadcast(below), "mask"),
            F.col("longer"),
        )


def _components(per_row: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """``fingerprint``, ``component_id`` and ``root`` of every distinct fingerprint of ``per_row`` (doc_id, fingerprint)."""
    codes = per_row.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    joined = connected(similar_fingerprints(codes.select("fingerprint"), node_limit), "a", "b")
    rooted = codes.join(joined.withColumnsRenamed({"node": "fingerprint", "component": "root"}), "fingerprint", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "fingerprint")), "rooted-fingerprints")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return stored(rooted.join(least, "root").select("fingerprint", "component_id", "root"), "fingerprint-components")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, ``fingerprint`` (long), ``component_id`` and ``root`` of every row of ``docs``.

    Rows link when their fingerprints differ in at most :data:`DISTANCE` bits; ``component_id`` is the smallest doc_id
    that links reach, the row's own included, and ``root`` a fingerprint that stands for the component. Copies of a text share a fingerprint and are linked once, through it. Rows
    with equal doc_ids stay apart rows; a null doc_id is reached but never the smallest (null, if there is no other).
    """
    per_row = stored(fingerprints(docs, shingle_words), "fingerprints")
    return per_row.join(_components(per_row, node_limit), "fingerprint", "left").select(
        "doc_id", "fingerprint", "component_id", "root"
    )


def kept_rows(rows: DataFrame) -> DataFrame:
    """``row`` of one row of every root: of the smallest doc_id, a null one last, and among equal ones of the smallest row."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    return rows.groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.row").alias("row"))


def one_of_each(docs: DataFrame, components: DataFrame | None = None, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` for every component: the one with the smallest doc_id, null last; any of those with equal ones.

    ``components`` comes from :func:`near_duplicates` with the same ``shingle_words``; without it the fingerprints taken
    here serve for the components too. Rows are told apart by their place, so repeated and null doc_ids neither lose a
    component nor keep two rows of one. Null and empty texts are one component; an empty table stays empty.
    """
    (row,) = unused_names(docs, "row")
    # Written out, so that every later read numbers the rows alike.
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    keys = numbered.select(F.struct(F.col(row).alias("row"), "doc_id").alias("doc_id"), "text")
    per_row = fingerprints(keys, shingle_words).select("doc_id.row", "doc_id.doc_id", "fingerprint")
    if components is None:
        per_row = stored(per_row, "fingerprints")
        components = _components(per_row.select("doc_id", "fingerprint"))
    roots = stored(components.select("fingerprint", "root").distinct(), "fingerprint-roots")
    kept = stored(kept_rows(per_row.join(roots, "fingerprint")).withColumnRenamed("row", row), "kept-rows")
    # The list has about as many rows as there are documents, so it is never broadcast, whatever Spark thinks of its size;
    # hashing it spares sorting the texts.
    return numbered.join(kept.hint("shuffle_hash"), row, "left_semi").select(*docs.columns)
