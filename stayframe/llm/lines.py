"""Lines that many documents share: counted by hash of the normalised line, dropped, and the rest reassembled by position.

Only hashes of lines travel, and they travel by line and document, then (added up before) by line, so a line that a third
of all documents hold is one row per task. Texts are shuffled once, as whole rows, to meet the places they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.llm.stored import stored
from stayframe.llm.words import NOT_SPACE, Texts, summed_by_text, text_blocks

#: Shorter lines (in code points, stripped) are never dropped.
LEAST_CHARS = 20
#: A line is dropped if at least so many documents hold it.
LEAST_DOCUMENTS = 3

_NEWLINE = 10


def split_lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines between line breaks, and of every text the number of its first line (and the end).

    An empty text is one empty line.
    """
    breaks = np.flatnonzero(texts.data == _NEWLINE)
    # A text has one line more than breaks; its first starts with it, every other one after a break.
    before = np.searchsorted(breaks, texts.bounds)
    bounds = before + np.arange(len(texts.bounds))
    starts = np.empty(bounds[-1], dtype=np.int64)
    ends = np.empty(bounds[-1], dtype=np.int64)
    first = np.zeros(bounds[-1], dtype=bool)
    first[bounds[:-1]] = True
    last = np.zeros(bounds[-1], dtype=bool)
    last[bounds[1:] - 1] = True
    starts[first], starts[~first] = texts.bounds[:-1], breaks + 1
    ends[last], ends[~last] = texts.bounds[1:], breaks
    return starts, ends, bounds


def _stripped(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space at both ends; an empty span for a blank line."""
    filled = np.flatnonzero(NOT_SPACE[texts.data])
    at, to = np.searchsorted(filled, starts), np.searchsorted(filled, ends)
    some = at < to
    new_starts, new_ends = starts.copy(), starts.copy()
    new_starts[some] = filled[at[some]]
    new_ends[some] = filled[to[some] - 1] + 1
    return new_starts, new_ends


def block_keys(texts: Texts, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in the text, and both halves of the 128-bit hash, of every line of at least ``least_chars``."""
    starts, ends, bounds = split_lines(texts)
    starts_key, ends_key = _stripped(texts, starts, ends)
    chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    long = np.flatnonzero(chars[ends_key] - chars[starts_key] >= least_chars)
    text = np.searchsorted(bounds, long, side="right") - 1
    # bytes.lower() changes ASCII letters alone.
    data = texts.data.tobytes().lower()
    digest = xxhash.xxh3_128_digest
    spans = zip(starts_key[long].tolist(), ends_key[long].tolist(), strict=True)
    keys = np.frombuffer(b"".join([digest(data[a:b]) for a, b in spans]), dtype="<i8").reshape(-1, 2)
    return text, long - bounds[text], keys[:, 0], keys[:, 1]


def line_keys(docs: DataFrame, document: list[str], least_chars: int = LEAST_CHARS) -> DataFrame:
    """The columns ``document``, ``high`` and ``low`` (a line's hash) and ``places`` of every distinct line of every row of ``docs``."""
    schema = docs.select(*document).schema
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(len(document))):
                text, place, high, low = block_keys(texts, least_chars)
                order = np.lexsort((place, low, high, text))
                new = np.ones(len(order), dtype=bool)
                new[1:] = np.any([values[order[1:]] != values[order[:-1]] for values in (text, high, low)], axis=0)
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(np.append(first, len(order)).astype(np.int32), place[order].astype(np.int32))
                rows = pa.array(texts.first + text[order[first]])
                own = [batch.column(k).take(rows) for k in range(len(document))]
                arrays = [*own, pa.array(high[order[first]]), pa.array(low[order[first]]), places]
                yield pa.RecordBatch.from_arrays(arrays, [*document, "high", "low", "places"])

    rows = docs.select(*document, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(per_batch, f"{columns}, high long, low long, places array<int>")


def common_lines(keys: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``high``, ``low``, ``n_documents`` and the largest ``doc_id`` (as ``holder``) of lines of at least ``least_documents`` documents."""
    held = keys.select("high", "low", "doc_id").distinct()
    counted = held.groupBy("high", "low").agg(F.count("*").alias("n_documents"), F.max("doc_id").alias("holder"))
    return counted.where(F.col("n_documents") >= least_documents)


def _without(lost: pa.ListArray, texts: Texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Every text without the lines at its places in ``lost``; counts of lines, and of those gone."""
    starts, ends, bounds = split_lines(texts)
    n_lines = np.diff(bounds)
    gone = np.zeros(bounds[-1], dtype=bool)
    places = lost.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    gone[np.repeat(bounds[:-1], counts) + places] = True
    n_gone = summed_by_text(gone, bounds)
    data = texts.data.tobytes()
    out = []
    for k, some in enumerate((n_gone > 0).tolist()):
        if some:
            kept = bounds[k] + np.flatnonzero(~gone[bounds[k] : bounds[k + 1]])
            out.append(b"\n".join([data[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)]))
        else:
            out.append(data[texts.bounds[k] : texts.bounds[k + 1]])
    return out, n_lines, n_gone


def drop_common_lines(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """``docs`` with the common lines gone from ``text``, and ``n_lines`` (before) and ``n_dropped`` of every row.

    Lines are compared stripped of white space and with A-Z lower-cased. A line of at least ``least_chars`` code points
    that at least ``least_documents`` doc_ids hold stays, with its repetitions, in the largest of them and goes from all
    others. Rows of one doc_id count as one document; null is a doc_id too, but never the largest. A null or empty text
    is one empty line and becomes (or stays) empty. Repeated rows all stay; an empty table stays empty. Columns
    ``n_lines`` and ``n_dropped`` of ``docs`` are replaced.
    """
    others = [name for name in docs.columns if name.lower() not in ("doc_id", "text", "n_lines", "n_dropped")]
    # What a row loses depends on its doc_id and text alone, so these identify it and repeated rows share an entry.
    identity = ["doc_id", "text_high", "text_low"]
    hashes = [F.xxhash64("text").alias("text_high"), F.xxhash64("text", F.lit(1)).alias("text_low")]
    keys = stored(line_keys(docs.select("doc_id", "text", *hashes), identity), "line-keys")
    common = stored(common_lines(keys, least_documents), "common-lines")
    losses = (
        keys.join(common, ["high", "low"])
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(*identity)
        .agg(F.flatten(F.collect_set("places")).alias("places"))
    )
    losses = stored(losses, "lost-lines")

    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("others"))
    rows = packed.select(*identity[:1], *hashes, F.col("text").cast("binary").alias("content"), "others")
    same = [rows[name].eqNullSafe(losses[name]) for name in identity]
    met = rows.join(losses, same[0] & same[1] & same[2], "left").select(rows["doc_id"], "content", "others", "places")
    key_type, others_type = (met.schema[name].dataType.simpleString() for name in ("doc_id", "others"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                part = batch.slice(texts.first, len(texts))
                kept, n_lines, n_gone = _without(part.column(3), texts)
                arrays = [part.column(0), pa.array(kept, pa.binary()), part.column(2), pa.array(n_lines), pa.array(n_gone)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "others", "n_lines", "n_dropped"])

    done = met.mapInArrow(per_batch, f"doc_id {key_type}, text binary, others {others_type}, n_lines long, n_dropped long")
    columns = {"doc_id": F.col("doc_id"), "text": F.decode("text", "UTF-8").alias("text")}
    columns |= {name: F.col("others")[name].alias(name) for name in others}
    kept_order = [columns[name] for name in docs.columns if name in columns]
    return done.select(*kept_order, "n_lines", "n_dropped")
