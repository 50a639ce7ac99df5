"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayframe.llm import contamination, packing, personal, quality, simhash
from stayframe.llm.stored import stored
from stayframe.llm.tokens import public_tokenizer
from stayframe.session import drop_workspaces, recorded_workspaces

#: Vocabulary of the training sequences; the file is installed on every node.
TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep, repeated rows included.

    Null, empty and short texts fail the rules. An empty table stays empty; without labels the rules alone decide.
    """
    statistics = stored(quality.rule_statistics(docs), "rule-statistics")
    return quality.keep_good(docs, quality.fit(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the SimHash operator links: four-word shingles, at most four differing bits.

    The one with the smallest doc_id stays, a null one last; of rows with equal doc_ids one. Null and empty texts are one
    group. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark: all rows but those with hits in a twentieth of their words.

    Null and empty texts have no words and stay, as do repeated rows that are clean. An empty table or benchmark drops nothing.
    """
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and ``n_chars`` (if there is one) counted anew.

    Null texts stay null, empty ones empty; rows are neither merged nor dropped, repeated ones and null doc_ids included.
    """
    model = personal.train(stored(personal.candidates(docs), "personal-data"))
    return personal.redact(docs, spark.sparkContext.broadcast(model))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row per bin with its token ids, and which documents start where in it.

    Null and empty texts have the end id alone; repeated rows are packed each. An empty table gives no sequences.
    """
    return packing.pack_sequences(docs, tokenizer=public_tokenizer(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The stages hash with XXH64, fit models and pack greedily, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage wrote besides its result goes when that is written, the result itself
    when the next stage's is."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with recorded_workspaces() as made:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # The stage's result is what was made last.
        drop_workspaces(spark, [*earlier, *made[:-1]])
        earlier = made[-1:]
    return docs
