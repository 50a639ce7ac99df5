"""Licence scans over a positional index of rare words.

A template is a licence notice with a key phrase that must stand in it. The index maps words to their positions in the
templates. Of each key phrase only the words with the highest inverse document frequency, measured over all documents, are
looked up in a text; each finding proposes where the template would begin, and proposals that agree are intersected.
Then the key phrase is compared word by word, and the rest of the template gives the score.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.llm.words import ALPHANUMERIC, Texts, Words, find_words, span_hashes, text_blocks

#: Words of a key phrase that are looked up.
RARE_WORDS = 2


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str
    base: bool = False

    def words(self) -> list[str]:
        return self.notice.split()

    def key_words(self) -> list[str]:
        return self.key.split()

    def key_start(self) -> int:
        own, key = self.words(), self.key_words()
        return next(i for i in range(len(own)) if own[i : i + len(key)] == key)


# The base phrases, then notices as they are commonly written, in lower case without punctuation.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("artistic", "the artistic license 2 0", "artistic license"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("eclipse", "eclipse public license v 2 0", "eclipse public license"),
    Template("eupl", "european union public licence", "european union public licence"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation", "free software you can redistribute it"),
    Template("gpl", "licensed under the gnu gpl", "gnu gpl"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             "for any purpose with or without fee"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             "hereby granted free of charge"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("odbl", "open database license", "open database license"),
    Template("ofl", "sil open font license version 1 1", "open font license"),
    Template("proprietary", "proprietary and confidential", "proprietary and confidential"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty", "as is without any express or implied warranty"),
)


def word_hashes(words: Sequence[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(word.encode()) for word in words])
    return span_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64), caseless=True)


def key_vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({word for template in templates for word in template.key_words()})


def document_frequencies(docs: DataFrame, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    """How many rows there are, and how many have each of ``words`` anywhere in their whole text."""
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    ranked = hashes[order]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(words), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for texts in text_blocks(batch.column(0)):
                own = find_words(texts, ALPHANUMERIC)
                at, place = _matches(ranked, span_hashes(texts.data, own.starts, own.ends, caseless=True))
                once = np.unique(own.text_of()[at] * len(words) + place)
                found[order] += np.bincount(once % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words))), pa.array(np.append(rows, found))], ["word", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(per_task, "word long, n long")
    total = {row["word"]: row["n"] for row in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return total.get(-1, 0), {word: total.get(k, 0) for k, word in enumerate(words)}


def _matches(ranked: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the ranked ones, and which ones they are."""
    place = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
    at = np.flatnonzero(ranked[place] == hashes)
    return at, place[at]


class PositionalIndex:
    """Postings of the rare words of every template's key phrase: word to (template, position in the template)."""

    def __init__(self, templates: Sequence[Template], rows: int, frequency: dict[str, int]):
        self.templates = list(templates)
        idf = {word: math.log((rows + 1) / (n + 1)) for word, n in frequency.items()}
        postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for number, template in enumerate(self.templates):
            start = template.key_start()
            ranked = sorted(enumerate(template.key_words()), key=lambda entry: (-idf[entry[1]], entry[0]))
            for position, word in ranked[:RARE_WORDS]:
                postings[word].append((number, start + position))
            self.needed.append(min(RARE_WORDS, len(ranked)))
        words = sorted(postings)
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        self.ranked = hashes[order]
        self.postings = [postings[words[k]] for k in order]
        self.words = [[word.encode() for word in template.words()] for template in self.templates]

    def find(self, texts: Texts, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, dict]]:
        """Every place of a template in a text: the text, and label, place, words, coverage and whether it is a base phrase."""
        at, place = _matches(self.ranked, hashes)
        # Matches come in the order of words, so a text's are one slice.
        owners, starts = np.unique(words.text_of()[at], return_index=True)
        bounds = [*starts.tolist(), len(at)]
        for i, text in enumerate(owners.tolist()):
            own = slice(bounds[i], bounds[i + 1])
            agreeing: dict[tuple[int, int], int] = defaultdict(int)
            for position, word in zip(at[own].tolist(), place[own].tolist(), strict=True):
                for number, offset in self.postings[word]:
                    agreeing[number, position - offset] += 1
            first, end = int(words.bounds[text]), int(words.bounds[text + 1])
            for (number, start), n in sorted(agreeing.items()):
                if n < self.needed[number]:
                    continue
                template, expected = self.templates[number], self.words[number]
                same = [
                    first <= start + k < end
                    and texts.data[words.starts[start + k] : words.ends[start + k]].tobytes().lower() == word
                    for k, word in enumerate(expected)
                ]
                key = template.key_start()
                if all(same[key : key + len(template.key_words())]):
                    found = {"label": template.label, "word": start - first + key, "n_words": len(template.key_words())}
                    yield text, found | {"coverage": sum(same) / len(same), "base": template.base}


_FOUND = pa.list_(
    pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("coverage", pa.float64()), ("base", pa.bool_())])
)
_FOUND_SCHEMA = "found array<struct<label string, word long, n_words int, coverage double, base boolean>>"


def scan(docs: DataFrame, index: Broadcast[PositionalIndex]) -> DataFrame:
    """doc_id, ``n_words`` and ``found``: all places of licence notices in the whole ``text`` of every row.

    ``word`` is where the key phrase starts, counted in words. A null text is empty and has nothing. Other columns are not
    read; rows are neither merged nor dropped, repeated and null doc_ids included. Notices come by place, those of one place
    by template. An empty table gives no rows.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_blocks(batch.column(1)):
                words = find_words(texts, ALPHANUMERIC)
                hashes = span_hashes(texts.data, words.starts, words.ends, caseless=True)
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                for text, notice in index.value.find(texts, words, hashes):
                    found[text].append(notice)
                keys = batch.column(0)[texts.first : texts.first + len(texts)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(words.counts()), pa.array(found, _FOUND)], ["doc_id", "n_words", "found"])

    key_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        per_batch, f"doc_id {key_type}, n_words long, {_FOUND_SCHEMA}"
    )


def find_licences(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Scan all rows with an index whose rare words are chosen by their frequency in the same rows; see :func:`scan`.

    Of words that are equally rare the one that comes first in its phrase is taken. In an empty table all are.
    """
    rows, frequency = document_frequencies(docs, key_vocabulary(templates))
    index = docs.sparkSession.sparkContext.broadcast(PositionalIndex(templates, rows, frequency))
    return scan(docs, index)
