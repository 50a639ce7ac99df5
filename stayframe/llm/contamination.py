"""Benchmark decontamination by winnowing.

Of every :data:`WINDOW` consecutive words the k-gram with the smallest hash is kept, for documents and benchmark items
alike. Two texts that share so many consecutive words keep the same k-gram of them, so joining kept k-grams misses no
shared window. Every join hit is then extended word by word on both sides, on the words themselves: hashes only find
candidates. Items shorter than a window are windows of their own length and keep their only k-gram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.llm.stored import stored, unused_names
from stayframe.llm.words import ALPHANUMERIC, Texts, Words, find_words, span_hashes, text_blocks, whole_windows, window_hashes

#: Consecutive shared words that count.
WINDOW = 13
GRAM = 8
#: Consecutive k-grams of a window, of which the smallest is kept: GRAM + CHOICES - 1 = WINDOW.
CHOICES = WINDOW - GRAM + 1
#: Bits of the filter of benchmark k-grams that every task gets: 2 MB, however large the benchmark is.
FILTER_BITS = 1 << 24
#: A document is contaminated from one hit word in this many.
CONTAMINATED_ONE_IN = 20

_HIT = pa.struct(
    [("gram_hash", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("gram", pa.string()),
     ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]
)
_HIT_SCHEMA = "hits array<struct<gram_hash long, size int, at long, gram string, before array<string>, after array<string>>>"


def winnowed(hashes: np.ndarray, words: Words) -> np.ndarray:
    """Places of the kept k-grams: for every window in one text, the rightmost of its smallest."""
    windows = whole_windows(words, WINDOW)
    if not len(windows):
        return windows
    least, place = hashes[windows], windows.copy()
    for step in range(1, CHOICES):
        other = hashes[windows + step]
        smaller = other <= least
        least = np.where(smaller, other, least)
        place = np.where(smaller, windows + step, place)
    # Places never go back within a text.
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def _passes(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), dtype=bool)
    place = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _block_hits(texts: Texts, short: Sequence[int], bits: np.ndarray | None, items: bool) -> tuple[np.ndarray, list[list[dict]]]:
    """Word counts, and per text its kept k-grams that pass the filter, each with the words that may extend it."""
    words = find_words(texts, ALPHANUMERIC)
    hashes = span_hashes(texts.data, words.starts, words.ends, caseless=True)
    counts = words.counts()
    text_of = words.text_of()
    hits: list[list[dict]] = [[] for _ in range(len(texts))]

    def spelled(first: int, end: int) -> list[str]:
        return [texts.data[words.starts[j] : words.ends[j]].tobytes().lower().decode() for j in range(first, end)]

    for size in (GRAM, *short):
        reach = WINDOW - GRAM if size == GRAM else 0
        grams = window_hashes(hashes, abs(size))
        places = winnowed(grams, words) if size == GRAM else whole_windows(words, -size)
        if items and size != GRAM:
            # An item that is shorter than a window is one window: its only k-gram of its own length.
            places = places[counts[text_of[places]] == -size]
        places = places[_passes(bits, grams[places])]
        for place in places.tolist():
            text = int(text_of[place])
            first, end = int(words.bounds[text]), int(words.bounds[text + 1])
            after = place + abs(size)
            hits[text].append(
                {
                    "gram_hash": int(grams[place].view(np.int64)),
                    "size": size,
                    "at": place - first,
                    "gram": " ".join(spelled(place, after)),
                    # Nearest word first.
                    "before": spelled(max(first, place - reach), place)[::-1],
                    "after": spelled(after, min(end, after + reach)),
                }
            )
    return counts, hits


def _with_hits(frame: DataFrame, key: str, short: Sequence[int], bits, items: bool) -> DataFrame:
    """row_id, the key, ``n_words`` and the kept k-grams of every row. ``short`` has lengths of short items, negated."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else bits.value
        for batch in batches:
            for texts in text_blocks(batch.column(2)):
                counts, hits = _block_hits(texts, short, table, items)
                rows = slice(texts.first, texts.first + len(texts))
                row_id, keys, _, text_hash = (column[rows] for column in batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [row_id, keys, pa.array(counts), pa.array(hits, pa.list_(_HIT)), text_hash],
                    ["row_id", key, "n_words", "hits", "text_hash"],
                )

    key_type = frame.schema[key].dataType.simpleString()
    selected = frame.select(
        F.monotonically_increasing_id().alias("row_id"), key, F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash")
    )
    return selected.mapInArrow(per_batch, f"row_id long, {key} {key_type}, n_words long, {_HIT_SCHEMA}, text_hash long")


def _filter_bits(spark: SparkSession, grams: DataFrame):
    """A bitmap of the benchmark's k-gram hashes, of fixed size, for dropping most of the documents' before the shuffle."""
    place = F.col("gram_hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = (
        grams.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(gram_hash & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    )
    bits = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    for row in rows:
        bits[row["word"]] = row["bits"]
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def _equal_run(left: str, right: str) -> Column:
    """How many words two lists share from their start."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    different = F.array_position(same, F.lit(False))
    return F.when(different > 0, different - 1).otherwise(F.size(left).cast("long"))


def shared_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """row_id, item_id, and the span ``start`` to ``end`` of document words that a hit extends to."""
    fields = ["gram_hash", "size", "at", "gram", "before", "after"]
    doc_grams = documents.select("row_id", F.explode("hits").alias("hit")).select("row_id", *[f"hit.{name}" for name in fields])
    # An item that repeats a k-gram with the same neighbours, or a repeated item, is one row.
    item_grams = (
        items.select("item_id", F.explode("hits").alias("hit"))
        .select("item_id", *[F.col(f"hit.{name}").alias(f"item_{name}") for name in fields if name != "at"])
        .distinct()
    )
    joined = doc_grams.join(
        stored(item_grams, "item-grams"),
        (F.col("gram_hash") == F.col("item_gram_hash")) & (F.col("size") == F.col("item_size")) & (F.col("gram") == F.col("item_gram")),
    )
    length = F.abs("size")
    extended = joined.withColumns(
        {"back": _equal_run("before", "item_before"), "on": _equal_run("after", "item_after")}
    ).where((F.col("size") < 0) | (F.col("back") + F.col("on") + length >= WINDOW))
    return extended.select(
        "row_id", "item_id", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + length + F.col("on")).alias("end")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, ``contaminated`` and text_hash of every row of ``docs``.

    Takes doc_id and text of ``docs``, item_id and text of ``benchmark``; other columns are ignored. Null and empty
    texts have no words, items without words have no windows. Rows that share a doc_id are judged one by one. A repeated
    item_id counts once per document; items without an item_id count as one item and are left out of the digest.
    """
    spark = docs.sparkSession
    words_only = _with_hits(benchmark, "item_id", (), None, items=True)
    lengths = words_only.where((F.col("n_words") > 0) & (F.col("n_words") < WINDOW)).select("n_words").distinct().collect()
    short = sorted(-row["n_words"] for row in lengths)
    items = stored(_with_hits(benchmark, "item_id", short, None, items=True), "benchmark-grams")
    bits = _filter_bits(spark, items.select(F.explode("hits.gram_hash").alias("gram_hash")))
    documents = stored(_with_hits(docs, "doc_id", short, bits, items=False), "document-grams")
    spans = stored(shared_spans(documents, items).distinct(), "shared-spans")
    words = spans.select("row_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("word")).distinct()
    n_hit = words.groupBy("row_id").agg(F.count("*").alias("n_hit"))
    found = spans.select("row_id", "item_id").distinct().groupBy("row_id").agg(
        F.count("*").alias("n_items"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.col("item_id").cast("string")))).alias("item_ids"),
    )
    n_words, hit = F.col("n_words"), F.coalesce("n_hit", F.lit(0))
    return (
        documents.select("row_id", "doc_id", "n_words", "text_hash")
        .join(n_hit, "row_id", "left")
        .join(found, "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            hit.cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("item_ids", F.lit("")), 256).alias("items_sha256"),
            ((hit > 0) & (CONTAMINATED_ONE_IN * hit >= n_words)).alias("contaminated"),
            "text_hash",
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Null and empty texts have no words and stay, repeated rows all stay or all go, and rows that share a doc_id (or have none)
    are told apart by their text. Without documents or items nothing goes. Columns with the names used here are kept.
    """
    key, text = unused_names(docs, "contaminated_id", "contaminated_text")
    found = decontaminate(docs, benchmark).where("contaminated")
    gone = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text))
    return docs.join(stored(gone, "contaminated"), same, "left_anti")
