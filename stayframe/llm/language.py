"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of characters are hashed into a fixed number of buckets, so the matrix of log-probabilities has a fixed size
per language and is broadcast. Training counts all labelled rows. Scoring counts the buckets of every text, and multiplies
these sparse counts by the matrix, a language at a time, in numpy.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.llm.words import Texts, text_blocks

#: Buckets per n-gram length, and the lengths.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
GRAM_SIZES = (1, 2, 3)
SMOOTHING = 0.5
UNDETERMINED = "und"
#: A model has at most so many languages: each is a column of the broadcast matrix.
MOST_LANGUAGES = 1000
#: Cells of counts, texts by buckets, that are held at a time; so few that they stay in a core's cache.
CELLS = 1 << 18

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = 32


def _folded(code: int) -> tuple[int, bool]:
    """What a character counts as, and whether it is a letter.

    Letters count in lower case, marks (accents written apart) as they are, and everything else as one separator.
    """
    character = chr(code)
    letter = character.isalpha()
    lower = character.lower()
    if not letter and unicodedata.category(character)[0] != "M":
        return _SEPARATOR, False
    return ord(lower) if len(lower) == 1 else code, letter


@functools.cache
def _basic_plane() -> tuple[np.ndarray, np.ndarray]:
    found = [_folded(code) for code in range(1 << 16)]
    return np.array([code for code, _ in found], dtype=np.uint32), np.array([letter for _, letter in found])


@dataclass(frozen=True)
class Characters:
    """The characters of a block of texts, folded; those of text ``i`` are ``bounds[i]`` to ``bounds[i + 1]``."""

    codes: np.ndarray
    bounds: np.ndarray
    lettered: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Characters:
        codes = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        bounds = starts[texts.bounds]
        if bounds[-1] != len(codes):
            # Bytes that are no UTF-8 were replaced; every text is decoded on its own.
            own = [texts.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True)]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), dtype=np.uint32)
            bounds = np.concatenate([[0], np.cumsum([len(text) for text in own])])
        folded, letter = _basic_plane()
        beyond = np.flatnonzero(codes >= 1 << 16)
        basic = codes.copy()
        basic[beyond] = 0
        out, is_letter = folded[basic], letter[basic]
        if len(beyond):
            rare, which = np.unique(codes[beyond], return_inverse=True)
            pairs = [_folded(code) for code in rare.tolist()]
            out[beyond] = np.array([code for code, _ in pairs], dtype=np.uint32)[which]
            is_letter[beyond] = np.array([own for _, own in pairs])[which]
        found = np.concatenate([[0], np.cumsum(is_letter)])[bounds]
        return cls(out, bounds, np.diff(found) > 0)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per n-gram length, the bucket of the n-gram that starts at each character, and whether it lies in one text."""
        n = len(self.codes)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))
        gram = np.zeros(n, dtype=np.uint64)
        for k, size in enumerate(GRAM_SIZES):
            # A character has at most 21 bits, so three of them fit.
            gram[: max(n - size + 1, 0)] |= self.codes[size - 1 :].astype(np.uint64) << np.uint64(21 * (size - 1))
            bucket = ((gram + np.uint64(size)) * _SPREAD) >> np.uint64(64 - BUCKET_BITS)
            yield bucket.astype(np.int64) + k * BUCKETS, np.arange(n) + size <= ends

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of texts: the first, and the text, bucket and count of every bucket of one n-gram length that one of them holds."""
        step = max(1, CELLS // BUCKETS)
        for k, (bucket, inside) in enumerate(self.grams()):
            bucket -= k * BUCKETS
            for first in range(0, len(self.bounds) - 1, step):
                own = self.bounds[first : first + step + 1]
                part = slice(own[0], own[-1])
                place = np.repeat(np.arange(len(own) - 1) * BUCKETS, np.diff(own)) + bucket[part]
                cells = np.bincount(place[inside[part]], minlength=(len(own) - 1) * BUCKETS)
                used = np.flatnonzero(cells)
                yield first, used >> BUCKET_BITS, (used & (BUCKETS - 1)) + k * BUCKETS, cells[used]


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether the checksum of the key as text falls into the part that is kept from training; false without a key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order, their log-priors, and log-probabilities by bucket (rows) and language."""

    languages: list[str]
    priors: np.ndarray
    log_probabilities: np.ndarray

    def scores(self, characters: Characters) -> np.ndarray:
        """The log-likelihood of every text (rows) in every language."""
        total = np.tile(self.priors, (len(characters.bounds) - 1, 1))
        for first, text, bucket, count in characters.counts():
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            if len(starts):
                for k in range(len(self.languages)):
                    total[first + text[starts], k] += np.add.reduceat(count * self.log_probabilities[bucket, k], starts, dtype=np.float64)
        return total


def count_grams(labelled: DataFrame) -> DataFrame:
    """Counts by ``lang`` and ``bucket`` over the whole texts of all rows, added up per task before the shuffle."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            languages = batch.column(1).to_numpy(zero_copy_only=False)
            for texts in text_blocks(batch.column(0)):
                own = languages[texts.first : texts.first + len(texts)]
                names, code = np.unique(own.astype(str), return_inverse=True)
                characters = Characters.of(texts)
                at_character = np.repeat(code, np.diff(characters.bounds))
                found = np.zeros(len(names) * len(GRAM_SIZES) * BUCKETS, dtype=np.int64)
                for bucket, inside in characters.grams():
                    place = at_character[inside] * (len(GRAM_SIZES) * BUCKETS) + bucket[inside]
                    found += np.bincount(place, minlength=len(found))
                for k, name in enumerate(names):
                    part = found[k * len(GRAM_SIZES) * BUCKETS : (k + 1) * len(GRAM_SIZES) * BUCKETS]
                    counts[name] = counts[name] + part if name in counts else part
                    rows[name] = rows.get(name, 0) + int((code == k).sum())
        for name, found in counts.items():
            # Bucket -1 counts rows.
            used = np.flatnonzero(found)
            buckets, numbers = np.append(used, -1), np.append(found[used], rows[name])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(buckets)), pa.array(buckets.astype(np.int32)), pa.array(numbers)], ["lang", "bucket", "n"]
            )

    counted = labelled.select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(
        per_task, "lang string, bucket int, n long"
    )
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """Fit on all rows with ``text`` and ``lang``; rows that lack either are ignored.

    Only counts reach the driver, at most ``BUCKETS`` for each n-gram length and language; a column with more than
    ``most_languages`` values is refused, as it is no column of languages. Without such rows the model knows no language.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = usable.select("lang").distinct().limit(most_languages + 1).count()
    if found > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    counts = count_grams(usable).toPandas()
    languages = sorted(counts["lang"].unique())
    code = {name: k for k, name in enumerate(languages)}
    table = np.zeros((len(GRAM_SIZES) * BUCKETS, len(languages)))
    column = counts["lang"].map(code).to_numpy(dtype=np.int64)
    bucket, number = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    grams = bucket >= 0
    table[bucket[grams], column[grams]] = number[grams]
    rows = np.zeros(len(languages))
    rows[column[~grams]] = number[~grams]
    sized = table.reshape(len(GRAM_SIZES), BUCKETS, len(languages)) + SMOOTHING
    logs = np.log(sized / sized.sum(axis=1, keepdims=True)).reshape(table.shape)
    return LanguageModel(languages, np.log(rows / max(rows.sum(), 1)), logs.astype(np.float32))


def predict(docs: DataFrame, model: Broadcast[LanguageModel]) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` (the probability of that language, 0 to 1) from the whole ``text`` of every row.

    A text that is null or has no letter, and any text when the model knows no language, is ``und`` with score 0. Of
    equally likely languages the first in the alphabet is taken. Other columns are not read.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        names = np.array([*known.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                n = len(texts)
                best, score = np.full(n, len(known.languages)), np.zeros(n)
                if known.languages:
                    characters = Characters.of(texts)
                    scores = known.scores(characters)
                    shares = np.exp(scores - scores.max(axis=1, keepdims=True))
                    shares /= shares.sum(axis=1, keepdims=True)
                    best = np.where(characters.lettered, shares.argmax(axis=1), best)
                    score = np.where(characters.lettered, shares.max(axis=1), 0.0)
                keys = batch.column(0)[texts.first : texts.first + n]
                yield pa.RecordBatch.from_arrays([keys, pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        per_batch, f"doc_id {key_type}, lang_pred string, score double"
    )
