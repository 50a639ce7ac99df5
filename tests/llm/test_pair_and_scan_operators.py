"""Licences, near copies, contamination and personal data against brute force, and their edge cases."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stayframe.llm import contamination, licences, personal, simhash
from stayframe.llm.components import connected
from stayframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = re.compile("[A-Z]")


def lowered(text):
    return UPPER.sub(lambda m: m.group().lower(), text or "")


def test_licence_query_equals_brute_force(spark, sf_dir, all_documents):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    rows = {row.doc_id: row for row in QUERIES["op1_rare_words"](spark, sf_dir).collect()}
    assert set(rows) == set(all_documents)
    for doc_id, text in all_documents.items():
        words = WORD.findall(lowered(text))
        places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        row = rows[doc_id]
        found = {label for _, label in places}
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert row.first_word == min((i for i, _ in places), default=None)
        assert row.last_word == max((i for i, _ in places), default=None)
        assert row.base_labels == ",".join(sorted(found))
        assert found <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1


def test_licences_on_edge_cases(spark, edge_documents):
    texts = [
        (1, "Released under the MIT License. ALL RIGHTS RESERVED"),
        (2, "cc, by; cc-BY cc-by-nc"),
        (3, "general public licence, public license general"),
        (4, "Permission is hereby granted, free of charge, to any person"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("found", F.lit("clash"))
    rows = {row.doc_id: row for row in licences.find_licences(docs).collect()}
    labels = {doc_id: sorted({notice.label for notice in row.found}) for doc_id, row in rows.items()}
    assert labels == {1: ["mit", "reserved"], 2: ["cc-by", "cc-by-nc"], 3: [], 4: ["mit"]}
    assert [notice.word for notice in rows[2].found if notice.base] == [0, 2, 4]
    assert licences.find_licences(edge_documents).count() == edge_documents.count()
    assert licences.find_licences(edge_documents.limit(0)).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for shingle in shingles:
        value = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def components(codes):
    """doc_id to smallest reachable doc_id, from doc_id to fingerprint."""
    ids = sorted(codes)
    values = np.array([codes[i] for i in ids], dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    out = {}
    for start in range(len(ids)):
        if ids[start] in out:
            continue
        waiting = [start]
        while waiting:
            at = waiting.pop()
            if ids[at] not in out:
                out[ids[at]] = ids[start]
                waiting += np.flatnonzero(near[at]).tolist()
    return out


def test_simhash_query_equals_brute_force(spark, sf_dir, all_documents):
    codes = {doc_id: fingerprint(text) for doc_id, text in all_documents.items()}
    expected = components(codes)
    rows = QUERIES["op2_gray_simhash"](spark, sf_dir).collect()
    assert {row.doc_id: (row.fingerprint, row.component_id) for row in rows} == {
        doc_id: (f"{codes[doc_id]:016x}", expected[doc_id]) for doc_id in codes
    }


def near_codes(seed=0):
    """Distinct codes: far ones, a chain of steps, and crowds around a few centres."""
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            code = centre
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                code ^= 1 << bit
            codes.add(code)
    chain = rng.getrandbits(64)
    for k in range(12):
        codes.add(chain)
        chain ^= 0b1111 << (4 * k)
    return sorted(codes)


@pytest.mark.parametrize("node_limit", [2048, 40])
def test_linked_fingerprints_join_exactly_those_that_reach_each_other(spark, node_limit):
    """Also when nodes beyond the limit are split into longer masks, again and again."""
    codes = near_codes()
    signed = [code - (1 << 64) if code >> 63 else code for code in codes]
    frame = spark.createDataFrame([(code,) for code in signed], "fingerprint long")
    joined = connected(simhash.similar_fingerprints(frame, node_limit), "a", "b").collect()
    groups = defaultdict(set)
    for row in joined:
        groups[row.component].add(row.node)
    expected = defaultdict(set)
    for code, least in components({code: code for code in codes}).items():
        expected[least].add(code - (1 << 64) if code >> 63 else code)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_gray_index_finds_all_pairs():
    codes = np.array(near_codes(1), dtype=np.uint64)
    index = simhash.GrayIndex(codes)
    ranks = simhash.gray_rank(index.codes)
    assert (ranks[1:] > ranks[:-1]).all()
    found = {frozenset((int(index.codes[a]), int(index.codes[b]))) for left, right in index.links() for a, b in zip(left, right)}
    close = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, 1)
    assert found == {frozenset((int(codes[a]), int(codes[b]))) for a, b in zip(*np.nonzero(close))}


def test_masks_leave_no_pair_out():
    for mask in (0, simhash.masks_below(0)[3], simhash.masks_below(simhash.masks_below(0)[3])[0]):
        longer = simhash.masks_below(mask)
        assert all(m & mask == mask for m in longer)
        free = [bit for bit in range(64) if not mask >> bit & 1]
        rng = random.Random(5)
        for _ in range(300):
            difference = sum(1 << bit for bit in rng.sample(free, min(4, len(free))))
            assert any(not difference & m for m in longer)


def test_near_duplicates_of_edge_cases(spark, edge_documents):
    rows = simhash.near_duplicates(edge_documents).collect()
    assert len(rows) == edge_documents.count()
    # No words: fingerprint zero, all linked; the rows without a doc_id too.
    wordless = [row for row in rows if row.fingerprint == 0]
    assert len(wordless) >= 3 and len({row.component_id for row in wordless}) == 1
    kept = simhash.one_of_each(edge_documents, simhash.near_duplicates(edge_documents))
    assert kept.columns == edge_documents.columns
    known = [row.doc_id for row in kept.collect() if row.doc_id is not None]
    assert len(known) == len(set(known)) == len({row.component_id for row in rows if row.component_id is not None})
    assert simhash.near_duplicates(edge_documents.limit(0)).count() == 0
    assert simhash.one_of_each(edge_documents.limit(0), simhash.near_duplicates(edge_documents.limit(0))).count() == 0


def contaminated(text, items):
    words = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORD.findall(lowered(item))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if own and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item_id)
    digest = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_of_short_items_and_edges(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(6)] + ["É", "Ab"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 40])))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "..."), (3, items[3][1]), (None, items[4][1]), (10, items[9][1])]
    long_item = items[8][1] if len(items[8][1].split()) >= 13 else " ".join(f"u{k}" for k in range(30))
    items.append((200, long_item))
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 200])))) for k in range(40)]
    docs += [(50, None), (51, ""), (52, f"x {long_item}, y"), (52, f"x {long_item}, y"), (None, long_item.upper()),
             (53, " ".join(long_item.split()[:12])), (54, " ".join(f"v{k}" for k in range(400)) + " " + long_item)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    rows = contamination.decontaminate(frame, benchmark).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    assert got == sorted((str(i), *contaminated(text, items)) for i, text in docs)
    clean = contamination.without_contaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert clean.count() == sum(not contaminated(text, items)[-1] for _, text in docs)
    nothing = contamination.decontaminate(frame, benchmark.limit(0)).collect()
    assert len(nothing) == len(docs) and not any(r.n_hit or r.contaminated for r in nothing)
    assert contamination.decontaminate(frame.limit(0), benchmark).count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    words = [f"w{k % 7}{k % 5}" for k in range(300)]
    column = pa.array([" ".join(words).encode()], pa.binary())
    (texts,) = contamination.text_blocks(column)
    found = contamination.find_words(texts, contamination.ALPHANUMERIC)
    hashes = contamination.span_hashes(texts.data, found.starts, found.ends, caseless=True)
    kept = set(contamination.winnowed(contamination.window_hashes(hashes, contamination.GRAM), found).tolist())
    assert all(kept & set(range(i, i + contamination.CHOICES)) for i in range(len(words) - contamination.WINDOW + 1))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            doubled = [int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
            if kind == "ip" and any(int(part) > 255 for part in match.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, match.start(), match.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["@", ".", "1", "2", "55", "256", "0", " ", "-", "+", "a", "b.c", "(", ")", "4111111111111111", "é", "\n", "7 7", "%"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert personal.base_spans(text) == base_spans(text), text


def test_personal_data_query_keeps_base_spans(spark, sf_dir, all_documents):
    for row in QUERIES["op5_weak_supervision"](spark, sf_dir).collect():
        expected = base_spans(all_documents[row.doc_id])
        joined = [f"{kind}:{start}:{end}" for kind, start, end in expected]
        assert row.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(row.spans.split(",")) | {""}
        for kind in PATTERNS:
            assert row[f"n_{kind}"] == sum(span[0] == kind for span in expected)


def test_estimates_trust_labelers_that_agree():
    patterns = {("card", (1, 1, 1, 0, 0, 0)): 500, ("card", (0, -1, -1, 0, 0, 0)): 400, ("card", (0, 1, 1, 0, 0, 0)): 20,
                ("card", (0, -1, 1, 0, -1, -1)): 30}
    likely = personal.estimated(patterns)
    assert likely["card", (1, 1, 1, 0, 0, 0)] > 0.95 and likely["card", (0, 1, 1, 0, 0, 0)] > 0.9
    assert likely["card", (0, -1, -1, 0, 0, 0)] < 0.05 and likely["card", (0, -1, 1, 0, -1, -1)] < 0.1


def test_redaction_and_edges(spark, edge_documents):
    texts = [(k, f"call +1 (555) 010-{k:04d} or mail é.{k}@mail{k % 7}.example.com", 7) for k in range(60)]
    texts += [(100, "nothing here 12", 15), (101, None, None), (102, "", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_chars long").withColumn("found", F.lit(1))
    found = personal.candidates(docs)
    model = spark.sparkContext.broadcast(personal.train(found))
    clean = {row.doc_id: row for row in personal.redact(docs, model).collect()}
    assert clean[0].text == "call [PHONE] or mail é[EMAIL]" and clean[0].n_chars == len(clean[0].text)
    assert (clean[100].text, clean[101].text, clean[102].text) == ("nothing here 12", None, "")
    assert personal.redact(docs, model).columns == docs.columns
    assert personal.find_personal_data(edge_documents).count() == edge_documents.count()
    assert personal.find_personal_data(edge_documents.limit(0)).count() == 0
    # Long runs of one sort of character take linear time.
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 50_000, "1 " * 100_000):
        assert personal.described(run.encode()) is not None


@pytest.mark.parametrize(
    "one_of_each",
    [lambda spark, docs: corpus_pipeline.near_duplicates(spark, docs, ""), lambda _, docs: simhash.one_of_each(docs, simhash.near_duplicates(docs))],
    ids=["stage", "simhash"],
)
def test_survivors_with_repeated_and_null_ids(spark, one_of_each):
    rng = random.Random(3)
    one, two, three, four = (" ".join(f"word{rng.randrange(5_000)}" for _ in range(60)) for _ in range(4))

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(((row.doc_id, row.text) for row in one_of_each(spark, docs).collect()), key=str)

    # Unrelated texts below one doc_id are two groups.
    assert kept([(1, one), (1, two)]) == sorted([(1, one), (1, two)], key=str)
    # Only the row that copies a document with a smaller doc_id goes.
    assert kept([(1, one), (1, two), (0, one)]) == sorted([(0, one), (1, two)], key=str)
    # A null doc_id is the last to stay, and one row of a group without any.
    assert kept([(None, one), (5, one), (None, two), (None, two), (None, three), (6, four)]) == sorted(
        [(5, one), (None, two), (None, three), (6, four)], key=str
    )


def plain_loose_spans(text, base):
    found = []
    for kind in personal.KINDS:
        if kind == "email" and "at" not in text:
            continue
        taken = [(start, end) for _, start, end in [*base, *found]]
        own = [match.span() for match in personal._LOOSE[kind].finditer(text)]
        found += [(kind, start, end) for start, end in own if not any(s < end and e > start for s, e in taken)]
    return found


def test_loose_spans_equal_plain_ones_and_long_lists_are_no_burden():
    rng = random.Random(2)
    parts = ["a (at) b.com", "x@y.org", "10.0.0.1", "+49 30 123 4567", "030 123 4567", "4111 1111 1111 1111", "fe80:0:0:0:0:0:0:1", " ", "\n", "at"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(12)))
        base = personal.base_spans(text)
        assert personal.loose_spans(text, base) == plain_loose_spans(text, base)
    seconds = []
    for n in (2_000, 8_000):
        text = "\n".join(f"Street {k}, mail{k}@example.com, (0{k % 900 + 100}) 555-{k % 9000 + 1000}" for k in range(n))
        started = time.perf_counter()
        personal.loose_spans(text, personal.base_spans(text))
        seconds.append(time.perf_counter() - started)
    assert seconds[1] < 12 * seconds[0] + 0.2
