"""One query per operator over its whole table, and the pipeline; DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.llm import (
    contamination,
    language,
    licences,
    lines,
    packing,
    periodic,
    personal,
    quality,
    sharding,
    simhash,
    tokens,
    toxicity,
    whitening,
)
from stayframe.llm.stored import stored
from stayframe.llm.tokens import public_tokenizer
from stayframe.session import new_workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    found = licences.find_licences(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda notice: notice["base"])

    def labels(notices):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda notice: notice["label"]))), ",")

    places = F.transform(base, lambda notice: notice["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda notice: notice["coverage"])), F.lit(0.0)).alias("score"),
    )


@query
def op2_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents, and the smallest doc_id that links reach from each."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


@query
def op3_fixed_size_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as equal-length sequences and read back."""
    documents = table(spark, sf_dir, "documents")
    shards = tokens.write_sequences(documents, new_workspace(spark, "sequences"), public_tokenizer("word_bpe_49k.json"))
    return tokens.read_checksums(shards, documents.schema["doc_id"].dataType.simpleString())


@query
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is shared with the benchmark."""
    return contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS_SQL = f"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"""
ORACLES["op4_winnowing"] = f"""
WITH doc AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
item AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
doc_window AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, n, item_id FROM doc_window JOIN item_window USING (n, words)),
hit_words AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@query
def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans by kind, and all spans."""
    found = personal.find_personal_data(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda span: span.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in personal.KINDS],
        F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"),
        F.concat_ws(",", "spans").alias("spans"),
    )


@query
def op6_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = language.held_out("doc_id", 4, 2)
    model = spark.sparkContext.broadcast(language.train(documents.where(~held_out)))
    return language.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document, and what the rules and the forest keep."""
    statistics = stored(quality.rule_statistics(table(spark, sf_dir, "documents")), "rule-statistics")
    model = quality.fit(statistics, table(spark, sf_dir, "labels"))
    return quality.judge(statistics, model).select("doc_id", *quality.STATISTICS, "base_failed", "kept", "score")


@query
def op8_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels of those not held out."""
    documents = table(spark, sf_dir, "documents")
    held_out = language.held_out("doc_id", 3, 1)
    model = spark.sparkContext.broadcast(toxicity.train(documents, table(spark, sf_dir, "labels").where(~held_out)))
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.TOXIC_SCORE).cast("int").alias("predicted"),
    )


@query
def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes (law ``bytes``)."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


@query
def op10_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document, in token ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizer("word_bpe_49k.json"))


@query
def op11_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


SPACED_WORD = r"[^\x20\x09-\x0D]+"


def made_periodic(documents: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by crc32 of doc_id, a period fills the text from some word on."""
    words = F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = documents.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns(
        {"n": F.size("words"), "g": F.floor(F.col("h") / 10)}
    )
    n, g = F.col("n"), F.col("g")
    # A null text has no words, and a null doc_id no crc32.
    cut = cut.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    a, p, rest = F.col("a").cast("int"), F.col("p").cast("int"), n - F.col("a").cast("int")
    period = F.slice("words", a + 1, p)
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    filled = F.array_join(F.concat(F.slice("words", F.lit(1), a), repeated), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), filled).otherwise(F.col("text")).alias("text"))


@query
def op12_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its digest without their repetitions."""
    found = periodic.find_runs(made_periodic(table(spark, sf_dir, "documents")))

    def order(one, other):
        longer = one["length"] * other["period"] - other["length"] * one["period"]
        first = F.when(longer > 0, -1).when(longer < 0, 1)
        return F.coalesce(first, F.when(one["start"] != other["start"], F.signum(one["start"] - other["start"]).cast("int")), F.signum(one["period"] - other["period"]).cast("int"))

    best = F.get(F.array_sort("runs", order), F.lit(0))
    texts = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(texts, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more documents share."""
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op13_common_lines"] = r"""
WITH line AS (
    SELECT doc_id, row, place, line, length(key) AS chars, key
    FROM (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, row, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
                FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
),
common AS (
    SELECT key, max(doc_id) AS holder FROM line WHERE chars >= 20 GROUP BY key
    HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3
),
judged AS (
    SELECT doc_id, row, place, line, common.key IS NOT NULL AND doc_id IS DISTINCT FROM holder AS dropped
    FROM line LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY row, doc_id
"""
