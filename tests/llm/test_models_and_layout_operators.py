"""Quality, toxicity, language, token files, sharding, packing and the pipeline against brute force, and their edge cases."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayframe.llm import language, packing, quality, sharding, simhash, tokens, toxicity
from stayframe.llm.queries import ORACLES, QUERIES, public_tokenizer
from stayframe.llm.words import text_blocks
from stayframe.session import new_workspace, recorded_workspaces
from stayframe.sources import storage

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rule_statistics(text):
    text = text or ""
    words = NOT_SPACE.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [line for line in text.split("\n") if NOT_SPACE.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_rule_statistics_equal_brute_force(spark, sf_dir, all_documents):
    for row in QUERIES["op7_isolation_forest"](spark, sf_dir).collect():
        expected = rule_statistics(all_documents[row.doc_id])
        assert tuple(row[name] for name in quality.STATISTICS) == expected
        assert row.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (row.base_failed and row.kept) and 0 <= row.score <= 1


def test_forest_separates_labelled_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = QUERIES["op7_isolation_forest"](spark, sf_dir).where("not base_failed")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = {(r.quality, r.kept): r["count"] for r in judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    bad, good = found.get((0, False), 0), found.get((1, True), 0)
    assert bad >= 0.9 * (bad + found.get((0, True), 0)) and good >= 0.98 * (good + found.get((1, False), 0))


def test_rule_statistics_of_edge_cases(spark, edge_documents):
    texts = ["a b c d e f g h i a b c d e f g h i\n\nx\nx\n x\n", "\n", "a a a a a a a a a", "q\n", "é é | #\n|"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {row.doc_id: row for row in quality.rule_statistics(docs.coalesce(1)).collect()}
    for i, text in enumerate(texts):
        assert tuple(rows[i][name] for name in quality.STATISTICS) == rule_statistics(text)
    statistics = quality.rule_statistics(edge_documents)
    assert statistics.count() == edge_documents.count()
    labels = spark.createDataFrame([(1, 1, "x"), (5, 1, "x"), (5, 1, "x"), (9, 0, "x"), (None, 1, "x"), (77, 0, "x"), (8, None, "x")], "doc_id long, quality int, score string")
    for usable in (labels, labels.where("quality = 1"), labels.where("quality = 0"), labels.limit(0)):
        model = quality.fit(statistics, usable)
        judged = quality.judge(statistics, model)
        assert judged.count() == edge_documents.count()
        kept = quality.keep_good(edge_documents, model)
        assert kept.columns == edge_documents.columns
        assert kept.count() == judged.where("kept").count()
    assert quality.judge(quality.rule_statistics(edge_documents.limit(0)), model).count() == 0


def held_out(key, parts, part):
    return zlib.crc32(str(key).encode()) % parts == part


def test_language_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op6_naive_bayes"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(row.held_out == held_out(row.doc_id, 4, 2) and 0 <= row.score <= 1 for row in rows)
    unseen = [row for row in rows if row.held_out]
    assert sum(row.lang == row.lang_pred for row in unseen) >= 0.97 * len(unseen)


def test_language_of_edge_cases(spark, edge_documents):
    empty = spark.sparkContext.broadcast(language.train(edge_documents.limit(0)))
    assert {row.lang_pred for row in language.predict(edge_documents, empty).collect()} == {"und"}
    model = spark.sparkContext.broadcast(language.train(edge_documents))
    assert model.value.languages == ["de", "en", "fr"]
    rows = language.predict(edge_documents, model).collect()
    assert len(rows) == edge_documents.count()
    assert all(row.lang_pred == "und" and row.score == 0 for row in rows if row.doc_id in (2, 3, 4))
    assert language.predict(edge_documents.limit(0), model).count() == 0


def test_language_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([("aB1c", "x"), ("", "x"), ("é", "y"), ("ab", "x")], "text string, lang string")
    counted = {(r.lang, r.bucket): r.n for r in language.count_grams(docs).collect()}
    assert (counted["x", -1], counted["y", -1]) == (3, 1)
    # n-grams of 1, 2 and 3 characters: 4 + 3 + 2 of "ab c", 2 + 1 of "ab"; one of "é".
    assert sum(n for (lang, bucket), n in counted.items() if lang == "x" and bucket >= 0) == 12
    assert sum(n for (lang, bucket), n in counted.items() if lang == "y" and bucket >= 0) == 1


def folded(text):
    kept = [c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text]
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in kept)


def bucket(gram):
    value = sum(ord(c) << (21 * i) for i, c in enumerate(gram)) + len(gram)
    return (value * 0x9E3779B97F4A7C15 % 2**64 >> (64 - language.BUCKET_BITS)) + (len(gram) - 1) * language.BUCKETS


def test_language_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Haus", "Öl", "maison", "été", "the", "ТЕСТ", "中文", "𐐀𐐨", "İx", "e\u0301", "12", "½", "🙂", "-"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(60)]
    rows = [(text, rng.choice(["de", "fr", "zz"])) for text in texts]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))

    def grams(text):
        own = folded(text)
        return Counter(bucket(own[i : i + size]) for size in language.GRAM_SIZES for i in range(len(own) - size + 1))

    counts = {lang: sum((grams(text) for text, own in rows if own == lang), Counter()) for lang in model.languages}
    expected = []
    for text in texts:
        scores = []
        for lang in model.languages:
            total = np.log(sum(own == lang for _, own in rows) / len(rows))
            for place, n in grams(text).items():
                size = place // language.BUCKETS
                of_size = sum(m for other, m in counts[lang].items() if other // language.BUCKETS == size)
                total += n * np.log((counts[lang][place] + 0.5) / (of_size + 0.5 * language.BUCKETS))
            scores.append(total)
        expected.append(scores)
    monkeypatch.setattr(language, "CELLS", 3 * language.BUCKETS)
    (block,) = text_blocks(pa.array([text.encode() for text in texts], pa.binary()))
    characters = language.Characters.of(block)
    assert characters.lettered.tolist() == [any(c.isalpha() for c in text) for text in texts]
    assert np.allclose(model.scores(characters), expected, rtol=1e-5)


def test_languages_are_bounded_and_marks_are_no_letters(spark):
    docs = spark.createDataFrame([(k, text, f"l{k}") for k, text in enumerate(["a", "½", "²", "①", "Ⅷ", "ª", "𐐀", "\u0301"])], "doc_id int, text string, lang string")
    with pytest.raises(ValueError, match="lang"):
        language.train(docs, most_languages=7)
    model = spark.sparkContext.broadcast(language.train(docs, most_languages=8))
    found = {row.doc_id: row.lang_pred for row in language.predict(docs, model).collect()}
    assert [found[k] == "und" for k in range(8)] == [False, True, True, True, True, False, False, True]


def test_toxicity_steps_and_scores_equal_plain_sums(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["bad", "Good", "fine", "ugly", "so", "é"], k=rng.randrange(9))) for _ in range(400)]
    rows = [(k, text, int(("bad" in text) != (rng.random() < 0.1))) for k, text in enumerate(texts)]
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(row[0], row[2]) for row in rows], "doc_id long, toxic int")
    places = {r.doc_id: r.place for r in labels.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id), 1) AS place").collect()}

    def features(text):
        (block,) = text_blocks(pa.array([text.encode()], pa.binary()))
        return set(toxicity.block_features(block)[0].tolist())

    z, n = defaultdict(float), defaultdict(float)

    def weight(f, strength):
        if abs(z[f]) <= strength:
            return 0.0
        return -(z[f] - math.copysign(strength, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA)

    for _ in range(toxicity.EPOCHS):
        for doc_id, text, toxic in sorted(rows, key=lambda row: places[row[0]]):
            own = [(f, 0.0 if f == "bias" else toxicity.L1) for f in [*features(text), "bias"]]
            weights = {f: weight(f, strength) for f, strength in own}
            gradient = 1 / (1 + math.exp(-sum(weights.values()))) - toxic
            gradient *= toxicity.TOXIC_WEIGHT if toxic else 1.0
            for f in weights:
                z[f] += gradient - (math.sqrt(n[f] + gradient**2) - math.sqrt(n[f])) / toxicity.ALPHA * weights[f]
                n[f] += gradient**2
    model = toxicity.train(docs, labels)
    assert len(model.features) > 3 and model.bias == pytest.approx(weight("bias", 0.0))
    assert {int(f): w for f, w in zip(model.features, model.weights)} == pytest.approx({f: weight(f, toxicity.L1) for f in z if f != "bias" and abs(z[f]) > toxicity.L1})
    shared = spark.sparkContext.broadcast(model)
    for row in toxicity.score(docs, shared).collect():
        total = weight("bias", 0.0) + sum(weight(f, toxicity.L1) for f in features(rows[row.doc_id][1]))
        assert row.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxicity_takes_one_row_of_a_key(spark):
    hot = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    docs = hot.union(spark.createDataFrame([(k, "other words") for k in range(2, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, toxic int")
    first = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(7), labels)
    assert first.features.tolist() == again.features.tolist() and first.bias == again.bias


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op8_ftrl"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert all(held_out(row.doc_id, 3, 1) and 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7) for row in rows)
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    ranked = sorted(rows, key=lambda row: row.score)
    above = sum(k for k, row in enumerate(ranked) if row.toxic) - len(toxic) * (len(toxic) - 1) / 2
    assert above / (len(toxic) * len(clean)) > 0.97


def test_toxicity_of_edge_cases(spark, edge_documents):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (99, 1), (None, 1), (7, 0), (7, 0), (3, 0)], "doc_id long, toxic int")
    for usable in (labels, labels.limit(0)):
        model = spark.sparkContext.broadcast(toxicity.train(edge_documents, usable))
        rows = toxicity.score(edge_documents, model).collect()
        assert len(rows) == edge_documents.count() and all(0 <= row.score <= 1 for row in rows)
    assert {row.score for row in rows} == {0.5}
    assert toxicity.score(edge_documents.limit(0), model).count() == 0


def test_toxicity_features_stay_in_their_text():
    (texts,) = text_blocks(pa.array([b"Aa bb cc", None, b"dd", b"aA BB"], pa.binary()))
    features, owner = toxicity.block_features(texts)
    assert Counter(owner.tolist()) == {0: 6, 2: 1, 3: 3}
    assert {f for f, o in zip(features, owner) if o == 3} < {f for f, o in zip(features, owner) if o == 0}


def test_piece_encoder_equals_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizer("word_bpe_49k.json")
    whole, own, rng = Tokenizer.from_file(path), tokens.PieceEncoder(path, "uint16"), random.Random(0)
    parts = ["a", "B", "é", "É", " ", "\n", ".", ",", "'s", "'", "1", "23", "\t", "İ", "ß", "µ", "<|endoftext|>", "<|ENDOFTEXT|>", "é",
             " ́", "ẞ", "ﬁ", "中文", "Σ", "ΑΣ ", "-", "🙂", "\x1c", "\x85", "ª", "ǅ", "‍", "..", "don't", "Ab.", "Ÿ"]
    written = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    expected = [whole.encode(text, add_special_tokens=False).ids for text in written]
    for remembered in (1_000_000, 50):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        for at in range(0, len(written), 100):
            (texts,) = text_blocks(pa.array([text.encode() for text in written[at : at + 100]], pa.binary()))
            assert [ids.tolist() for ids in own.encode(texts)] == expected[at : at + 100]


def test_token_files_round_trip(spark, edge_documents):
    from tokenizers import Tokenizer

    path = public_tokenizer("word_bpe_49k.json")
    form = tokens.SequenceFormat(length=128, per_batch=4)
    folder = new_workspace(spark, "test-sequences")
    shards = tokens.write_sequences(edge_documents.repartition(3), folder, path, form)
    whole = Tokenizer.from_file(path)
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in edge_documents.collect()), key=lambda r: r[:2])
    expected = [(r[1] if r[0] else None, np.array([*whole.encode(r[2], add_special_tokens=False).ids, 1], dtype="<u4")) for r in texts]
    rows = sorted(tokens.read_checksums(shards, "bigint").collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, ids) in zip(rows, expected, strict=True):
        assert (row.doc_id, row.start) == (doc_id, start)
        start += row.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in expected)
    for shard in shards.collect():
        uri, _ = tokens.shard_uri(shard.path, shard.shard)
        mapped = tokens.MappedSequences(uri)
        assert len(mapped) == -(-shard.n_tokens // 128)
        parts = [mapped[k] for k in reversed(range(len(mapped)))][::-1]
        stream = np.concatenate([ids[np.array(mask)] for ids, mask in parts])
        assert len(stream) == shard.n_tokens
        assert np.array_equal(stream, np.concatenate(list(tokens._stored_ids(uri))))
        assert not any(ids.flags.owndata for ids, _ in parts)
    empty = tokens.write_sequences(edge_documents.limit(0), new_workspace(spark, "test-sequences"), path, form)
    assert tokens.read_checksums(empty, "bigint").count() == 0


def test_sharding_query(spark, sf_dir, all_documents):
    rows = QUERIES["op9_virtual_slots"](spark, sf_dir).collect()
    assert {row.doc_id for row in rows} == set(all_documents)
    by_shard = defaultdict(list)
    for row in rows:
        data = (all_documents[row.doc_id] or "").encode()
        assert (row["size"], row.text_crc32, row.law) == (len(data) + 16, zlib.crc32(data), "bytes")
        by_shard[row.shard].append(row)
    assert set(by_shard) <= set(range(40))
    for own in by_shard.values():
        assert sorted(row.slot for row in own) == list(range(len(own)))
    loads = sorted(sum(row["size"] for row in own) for own in by_shard.values())
    assert loads[-1] - loads[0] <= max(row["size"] for row in rows)


def test_sharding_of_edge_cases_and_written_shards(spark, edge_documents):
    placed = sharding.shard_documents(edge_documents, shards=3, slots=16)
    assert placed.count() == edge_documents.count()
    by_shard = defaultdict(list)
    for row in placed.collect():
        by_shard[row.shard].append(row.slot)
    assert all(sorted(own) == list(range(len(own))) for own in by_shard.values())
    assert sharding.shard_documents(edge_documents.limit(0)).count() == 0
    slot_map = sharding.SlotMap(spark, new_workspace(spark, "test-slot-map"))
    slot_map.store([k % 3 for k in range(16)])
    folder = new_workspace(spark, "test-shards")
    sharding.write_shards(edge_documents.drop("shard"), slot_map.read(), folder, slots=16)
    assert spark.read.parquet(folder).count() == edge_documents.count()


def test_equal_rows_without_a_key_spread_over_shards(spark):
    docs = spark.range(5_000).repartition(4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    placed = sharding.shard_documents(docs, shards=4, slots=512)
    counts = sorted(row["count"] for row in placed.groupBy("shard").count().collect())
    assert len(counts) == 4 and counts[-1] < 1.1 * counts[0]
    shards = tokens.write_sequences(docs, new_workspace(spark, "test-sequences"), public_tokenizer("word_bpe_49k.json"))
    rows = tokens.read_checksums(shards, "bigint")
    assert rows.count() == 5_000 and rows.select("ids_crc32").distinct().count() == 1 and rows.select("start").distinct().count() == 5_000


def test_rebalancing_moves_few_slots_and_keeps_versions(spark):
    rng = random.Random(2)
    loads = [sharding.SlotLoad(k, rng.randint(1, 1000), 1) for k in range(512)]
    placed = sharding.balanced_map(loads, 8, 512)
    slot_map = sharding.SlotMap(spark, new_workspace(spark, "test-slot-map"))
    assert slot_map.store(placed) == 0
    assert slot_map.rebalance(loads, 9) == 1
    edited = slot_map.placed()
    moved = [k for k in range(512) if edited[k] != placed[k]]
    # Little moves but what the new shard takes.
    assert len(moved) < 512 / 9 * 1.5 and sum(edited[k] == 8 for k in moved) >= 0.9 * len(moved)
    total = [sum(load.size for load in loads if edited[load.slot] == s) for s in range(9)]
    assert max(total) <= 1.02 * sum(total) / 9
    assert slot_map.placed(0) == placed
    assert max(sharding.rebalanced_map(edited, loads, 5)) == 4


def test_plan_equals_a_packing_of_single_pieces():
    rng = random.Random(1)
    for capacities in ((16, 32, 64), (10,), (2048, 4096, 8192, 16384)):
        for n in (1, 7, 400):
            lengths = [min(capacities[-1], max(1, int(rng.expovariate(5 / capacities[-1])))) for _ in range(n)]
            plan = packing.PackingPlan.of(Counter(lengths), capacities)
            seen: Counter = Counter()
            ranks = []
            for length in lengths:
                ranks.append(seen[length])
                seen[length] += 1
            bins = defaultdict(list)
            for where, capacity, offset, length in zip(*map(np.ndarray.tolist, plan.place(np.array(lengths), np.array(ranks))), lengths):
                bins[where].append((offset, length, capacity))
            assert sorted(bins) == list(range(len(bins)))
            for own in bins.values():
                own.sort()
                ends = [0, *(offset + length for offset, length, _ in own)]
                assert [offset for offset, _, _ in own] == ends[:-1]
                assert {capacity for _, _, capacity in own} == {min(c for c in capacities if c >= ends[-1])}


def test_best_fit_never_opens_a_bin_beside_one_with_room():
    rng = random.Random(4)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 40) for _ in range(60))
        groups = packing._best_fit(histogram, (40,), 40)
        free = sorted((40 - group.filled for group in groups for _ in range(group.bins)), reverse=True)
        # Any two bins together hold more than one bin could, but for the last.
        assert all(a + b < 40 for a, b in zip(free, free[1:]))


def test_packing_of_edge_cases(spark, edge_documents):
    rows = packing.pack(edge_documents, (64, 256, 1024)).collect()
    lengths = sorted(len((r.text or "").encode()) + 1 for r in edge_documents.collect())
    assert sum(row.n_tokens for row in rows) == sum(lengths)
    bins = defaultdict(list)
    for row in rows:
        bins[row.bin].append(row)
        assert row.start == row.piece * 1024
    for own in bins.values():
        spans = sorted((row.offset, row.offset + row.n_tokens) for row in own)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= own[0].capacity
    assert packing.pack(edge_documents.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = connection.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    pd.testing.assert_frame_equal(
        got[columns].sort_values(columns).reset_index(drop=True), expected[columns].sort_values(columns).reset_index(drop=True), check_dtype=False
    )


def test_pipeline_equals_its_operators_one_by_one(spark, sf_dir, all_documents):
    from test_pair_and_scan_operators import base_spans, components, contaminated, fingerprint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in QUERIES["op7_isolation_forest"](spark, sf_dir).where("kept").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = [
        lambda ids: ids & kept,
        lambda ids: {i for i, least in components({i: fingerprint(all_documents[i]) for i in ids}).items() if i == least},
        lambda ids: {i for i in ids if not contaminated(all_documents[i], items)[-1]},
        lambda ids: ids,
    ]
    ids = set(all_documents)
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        rows = docs.collect()
        ids = brute(ids)
        assert docs.columns == columns and sorted(row.doc_id for row in rows) == sorted(ids), name
    assert not any(base_spans(row.text) for row in rows)
    assert all(row.n_chars == len(row.text) for row in rows)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizer(corpus_pipeline.TOKENIZER))
    with recorded_workspaces() as made:
        bins = corpus_pipeline.run(spark, sf_dir).collect()
    assert [path for path in made if storage.exists(spark, path)] == made[-1:]
    assert segments(bins) == Counter((row.doc_id, (*whole.encode(row.text, add_special_tokens=False).ids, tokens.END_ID)) for row in rows)


def segments(bins):
    """The documents of packed sequences, put together from their pieces; checks what every sequence must be."""
    assert sorted(row.bin for row in bins) == list(range(len(bins)))
    pieces = defaultdict(list)
    for row in bins:
        assert row.capacity in packing.CAPACITIES and len(row.ids) == row.capacity and row.starts[0] == 0 and row.starts == sorted(row.starts)
        assert set(row.ids[row.n_tokens :]) <= {tokens.END_ID} and row.n_tokens > 0
        for doc_id, piece, start, end in zip(row.doc_ids, row.pieces, row.starts, [*row.starts[1:], row.n_tokens], strict=True):
            pieces[doc_id].append((piece, tuple(row.ids[start:end])))
    found = Counter()
    for doc_id, own in pieces.items():
        # Only documents of one piece stand on several rows here.
        if max(piece for piece, _ in own):
            assert [piece for piece, _ in sorted(own)] == list(range(len(own)))
            found[doc_id, tuple(token for _, ids in sorted(own) for token in ids)] += 1
        else:
            found.update((doc_id, ids) for _, ids in own)
    return found


@pytest.mark.parametrize("tokenizer", [None, "word_bpe_49k.json"])
def test_sequences_hold_each_document_once(spark, edge_documents, tokenizer):
    from tokenizers import Tokenizer

    path = tokenizer and public_tokenizer(tokenizer)

    def encoded(text):
        if path is None:
            return [byte + 2 for byte in text.encode()]
        return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids

    rows = [(row.doc_id, row.text or "") for row in edge_documents.collect()]
    expected = Counter((doc_id, (*encoded(text), tokens.END_ID)) for doc_id, text in rows)
    assert segments(packing.pack_sequences(edge_documents, tokenizer=path).collect()) == expected
    placed = packing.pack(edge_documents, tokenizer=path).collect()
    assert sum(row.n_tokens for row in placed) == sum(n * len(ids) for (_, ids), n in expected.items())
    assert packing.pack_sequences(edge_documents.limit(0), tokenizer=path).count() == 0


def test_equal_rows_are_packed_in_many_tasks(spark):
    docs = spark.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    placed = packing.pack(docs, (64,))
    assert placed.count() == 5_000 and {row.n for row in placed.groupBy("bin", "offset").agg(F.count("*").alias("n")).collect()} == {1}


def test_packing_query_counts_ids(spark, sf_dir, all_documents):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    total = Counter()
    for row in QUERIES["op10_variable_best_fit"](spark, sf_dir).collect():
        total[row.doc_id] += row.n_tokens
    assert total == {doc_id: len(whole.encode(text or "", add_special_tokens=False).ids) + 1 for doc_id, text in all_documents.items()}


def test_pipeline_stages_on_edge_cases(spark, sf_dir, edge_documents):
    for docs in (edge_documents, edge_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            docs.count()
    assert simhash.BLOCKS - simhash.DISTANCE == 2


def thue_morse(length, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(length))


def colliding_documents():
    """Texts whose words, lines and windows have equal values of any polynomial mod 2**64."""
    one, other = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    plain = " ".join(f"w{k}" for k in range(30))
    return [f"{one} {other} {one}", f"{one}\n{other}\n{plain}", " ".join([one, *"bcdefgh", plain, other, *"bcdefgh"])]


@pytest.mark.parametrize("weak", [False, True])
def test_equal_hashes_are_checked_on_the_bytes(monkeypatch, weak):
    from tokenizers import Tokenizer

    from stayframe.llm import words

    if weak:
        hashes = words.span_hashes
        for module in (words, quality):
            monkeypatch.setattr(module, "span_hashes", lambda *args, **kind: hashes(*args, **kind) & np.uint64(3))
    documents = [*colliding_documents(), "x y\nx y\nx z\n", "a b c d e f g h i a b c d e f g h j"]
    path = public_tokenizer("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    (texts,) = text_blocks(pa.array([text.encode() for text in documents], pa.binary()))
    expected = [whole.encode(text, add_special_tokens=False).ids for text in documents]
    assert [ids.tolist() for ids in tokens.PieceEncoder(path, "uint16").encode(texts)] == expected
    found = quality.block_statistics(texts)
    for i, text in enumerate(documents):
        assert tuple(found[name][i] for name in quality.STATISTICS) == rule_statistics(text)
