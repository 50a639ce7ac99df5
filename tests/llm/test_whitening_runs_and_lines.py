"""Whitening, periodic runs and common lines against brute force and SQL, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayframe.llm import lines, periodic, whitening
from stayframe.llm.queries import QUERIES, made_periodic
from stayframe.llm.suffixtree import Extensions, RangeMinimum
from stayframe.llm.words import NOT_SPACE, find_words, text_blocks

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


# Whitening


def brute_whitening(vectors):
    """(distinct x, n, S, covariance) by the definition, in exact fractions rounded once."""
    x = sorted({tuple(math.floor(256 * c) for c in vector) for vector in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(column) for column in zip(*x, strict=True)]
    y = [[n * value - total for value, total in zip(row, sums, strict=True)] for row in x]
    return x, n, sums, np.array([[float(Fraction(sum(row[a] * row[b] for row in y), n**3)) for b in range(d)] for a in range(d)])


def check_whitening(rows, by_key, components):
    _, n, sums, v = brute_whitening(by_key.values())
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert {(row.vec_id, row.component) for row in rows} == {(key, k + 1) for key in by_key for k in range(components)}
    signs = defaultdict(set)
    for row in rows:
        x = [math.floor(256 * c) for c in by_key[row.vec_id]]
        assert row.n == n and row.deviation == sum((n * value - total) ** 2 for value, total in zip(x, sums, strict=True))
        k = row.component - 1
        expected = sum((value - total / n) * axis for value, total, axis in zip(x, sums, axes[:, k], strict=True)) / math.sqrt(values[k])
        if abs(expected) > 1e-6:
            signs[k].add(1 if abs(row.whitened - expected) < 1e-8 else -1 if abs(row.whitened + expected) < 1e-8 else 0)
        assert abs(row.explained - values[k] / np.trace(v)) < 1e-12 and 0 <= row.identity_error < 1e-10
    assert all(found in ({1}, {-1}) for found in signs.values())


def test_whitening_query_equals_brute_force(spark, sf_dir):
    rows = QUERIES["op11_polarised_whitening"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(rows, {row.vec_id: row.embedding for row in table}, 4)


def test_polarisation_equals_the_covariance_of_any_size():
    rng = np.random.default_rng(3)
    for largest in (3, 1 << 20, 1 << 55):
        x = rng.integers(-largest, largest, (50, 5))
        n, sums = len(x), [sum(map(int, column)) for column in x.T]
        y = whitening.centred(x, n, sums)
        assert y.tolist() == [[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x]
        assert whitening.squared_sums(y).tolist() == [sum(int(v) ** 2 for v in column) for column in y.T]
    for number in (0, 5, -5, 1 << 30, -(1 << 30), (1 << 90) + 7, -(1 << 90) - 7):
        assert whitening.whole(dict(enumerate(whitening.digits(number)))) == number


def test_whitening_of_edge_cases(spark):
    nan, infinity = float("nan"), float("inf")
    vectors = {
        1: [0.5, 1.0, -3.0], 2: [0.5, 1.0, -3.0], 3: [0.501, 2.0, 0.25], 4: [-7.0, 0.0, 1.0], 5: [30.0, -1000.0, 0.0], 6: [0.0, 0.1, -0.1],
        7: None, 8: [1.0, None, 2.0], 9: [nan, 1.0, 1.0], 10: [infinity, 1.0, 1.0], 11: [1.0, -infinity, 1.0], 12: [1.0, 2.0], 13: [], 14: [1e300, 0.0, 0.0],
    }
    rows = [(key, vector) for key, vector in vectors.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({name: F.lit("clash") for name in ("x", "key", "n", "component")})
    kept = {key: vectors[key] for key in range(1, 7)}
    check_whitening(whitening.whiten(df).collect(), kept, 3)
    doubled = whitening.whiten(df.union(df).union(df.withColumn("vec_id", F.lit(None).cast("long"))))
    assert doubled.count() == 3 * 3 * len(kept) and doubled.where("n <> 5").count() == 0
    check_whitening(doubled.where("vec_id IS NOT NULL").dropDuplicates(["vec_id", "component"]).collect(), kept, 3)
    # Vectors on a line have one component, equal ones and none have no rows.
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], "vec_id int, embedding array<float>"))
    assert {row.component for row in line.collect()} == {1} and line.count() == 5
    assert whitening.whiten(df.where("vec_id < 3")).count() == 0 and whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns


# Periodic runs


def brute_runs(words, least_words=24, least_periods=3):
    n, found = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_words, least_periods * q):
                if all(any(words[k] != words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(words):
    runs = brute_runs(words)
    lost = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=(None, None, None))
    return (
        len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        digest("".join(f"{start},{length},{q}\n" for start, length, q in runs)),
        digest(" ".join(word for i, word in enumerate(words) if i not in lost)),
    )


def periodic_words(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]


def as_row(row):
    return (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.runs_sha256, row.collapsed_sha256)


def test_runs_query_equals_brute_force(spark, sf_dir, all_documents):
    rows = QUERIES["op12_suffix_tree_runs"](spark, sf_dir).collect()
    assert len(rows) == len(all_documents) and sum(row.n_runs > 0 for row in rows) > 10
    for row in rows:
        words = periodic_words(row.doc_id, all_documents[row.doc_id])
        if len(words) < 3000:
            assert as_row(row) == brute_row(words), row.doc_id


def test_documents_become_periodic(spark, edge_documents):
    made = made_periodic(edge_documents).collect()
    assert len(made) == edge_documents.count()
    documents = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 40))) for k in range(300)], "doc_id long, text string")
    for row in made_periodic(documents).collect():
        assert SPACED.findall(row.text) == periodic_words(row.doc_id, " ".join(f"w{j}" for j in range(row.doc_id % 40)))


def random_words(rng):
    words, k = [], rng.choice([1, 2, 3, 26])
    for _ in range(rng.randrange(5)):
        part = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(rng.randrange(1, 15))]
        words += (part * 20)[: rng.randrange(1, 12 * len(part))] if rng.random() < 0.6 else part
    return words


@pytest.mark.parametrize("together", [1, 1 << 16])
@pytest.mark.parametrize(("least_words", "least_periods"), [(24, 3), (2, 2), (10, 4)])
def test_runs_equal_brute_force(monkeypatch, together, least_words, least_periods):
    monkeypatch.setattr(periodic, "TREE_WORDS", together)
    rng = random.Random(least_words)
    for _ in range(100):
        documents = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        (texts,) = text_blocks(pa.array([" ".join(words).encode() for words in documents], pa.binary()))
        words = find_words(texts, NOT_SPACE)
        found = periodic.block_runs(texts, words, least_words, least_periods)
        expected = [
            (int(first) + start, length, q)
            for own, first in zip(documents, words.bounds, strict=False)
            for start, length, q in brute_runs(own, least_words, least_periods)
        ]
        assert list(zip(found.start.tolist(), found.length.tolist(), found.period.tolist(), strict=True)) == expected


def test_extensions_and_ranks_equal_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        n, letters = rng.randrange(1, 50), rng.choice([1, 2, 5])
        symbols = [rng.randrange(1, letters + 1) for _ in range(n)]
        tree = Extensions([*symbols, 0], letters + 1)
        assert np.argsort(tree.ranks()).tolist() == sorted(range(n + 1), key=lambda i: [*symbols[i:], 0])
        for i in range(n):
            others = np.array([j for j in range(n) if j != i], dtype=np.int64)
            if len(others):
                shared = tree.common(np.full(len(others), i), others).tolist()
                assert shared == [next(k for k in range(n + 1) if [*symbols, 0][i + k : i + k + 1] != [*symbols, -1][j + k : j + k + 1]) for j in others]
    for n in (1, 31, 32, 33, 64, 65, 1000):
        values = np.array([rng.randrange(99) for _ in range(n)], dtype=np.int32)
        ends = np.array([sorted(rng.choices(range(n), k=2)) for _ in range(200)])
        assert RangeMinimum(values).of(ends[:, 0], ends[:, 1]).tolist() == [values[a : b + 1].min() for a, b in ends.tolist()]


def test_runs_of_edge_cases(spark, edge_documents):
    rows = periodic.find_runs(edge_documents).collect()
    assert sorted((str(row.doc_id), row.n_words) for row in rows) == sorted(
        (str(row.doc_id), len(SPACED.findall(row.text or ""))) for row in edge_documents.collect()
    )
    assert all(row.runs == [] and row.collapsed == "" for row in rows if row.n_words == 0)
    assert periodic.find_runs(edge_documents.limit(0)).count() == 0
    texts = ["a " * 100, "\t".join(["x\ny z"] * 8), "ab Ab " * 30, "one two " * 11 + "one", "é 中 " * 12, "p q " * 12 + "r " * 24 + "p q " * 12]
    rows = periodic.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for row in rows:
        words = SPACED.findall(texts[row.doc_id])
        assert [tuple(run) for run in row.runs] == brute_runs(words)
        assert digest(row.collapsed) == brute_row(words)[-1]


def test_long_periodic_text():
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(30_000))
    (texts,) = text_blocks(pa.array([" ".join([base] * 4).encode()], pa.binary()), 1 << 30)
    found = periodic.block_runs(texts, find_words(texts, NOT_SPACE))
    assert (found.start.tolist(), found.length.tolist(), found.period.tolist()) == ([0], [120_000], [30_000])


# Common lines


def brute_lines(rows, least_documents=3, least_chars=20):
    def key(line):
        return re.sub("[A-Z]", lambda letter: letter[0].lower(), line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = []
        for line in own:
            ids = holders.get(key(line), ())
            if len(ids) < least_documents or doc_id == max(i for i in ids if i is not None):
                kept.append(line)
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


LINE = "  A line of THIS text stands in many documents\t"


def test_common_lines_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [LINE, LINE.strip(), LINE.lower(), "short", "", "\t", "x" * 19, "é" * 20, "É" * 20, "y" * 20, " \r" + "y" * 20, *[f"line number {k} of all the others" for k in range(40)]]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", "\n", *["\n".join(rng.choices(pool, k=rng.randrange(1, 12))) for _ in range(6)]])) for _ in range(120)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({name: F.lit("clash") for name in ("places", "holder", "high", "n_lines", "others", "content")})
    found = lines.drop_common_lines(docs.repartition(5))
    assert found.columns == ["doc_id", "text", "places", "holder", "high", "others", "content", "n_lines", "n_dropped"]
    assert found.where("places <> 'clash' OR others <> 'clash'").count() == 0
    got = sorted(((row.doc_id, row.n_lines, row.n_dropped, row.text) for row in found.collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str) and sum(row[2] for row in got) > 100


def test_common_lines_of_edge_cases(spark, edge_documents):
    found = lines.drop_common_lines(edge_documents, least_documents=2).collect()
    rows = [(row.doc_id, row.text) for row in edge_documents.collect()]
    got = sorted(((row.doc_id, row.n_lines, row.n_dropped, row.text) for row in found), key=str)
    assert got == sorted(brute_lines(rows, 2), key=str)
    assert lines.drop_common_lines(edge_documents.limit(0)).count() == 0
