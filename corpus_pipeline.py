"""From raw documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it
kept. All but the last return the columns of `documents`, whatever further
columns it has. Null and empty texts are scored, compared, mixed and packed
like others (as documents without words); rows with null or repeated ids are
rows of their own. An empty table gives empty stages.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import mixing, packing, simhash, substrings, toxicity as toxic
from barloom.llm.common import stored
from barloom.llm.queries import LEVELS, MIX, PACK, WEIGHTS


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    settings = toxic.Settings()
    model = toxic.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), settings)
    return toxic.below(docs, model, settings, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand elsewhere too.

    A null text becomes an empty one; other columns stay, n_chars follows the text.
    """
    kept = substrings.without_repeats(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.selected(docs, {n: F.expr(e) for n, e in LEVELS.items()}, WEIGHTS, **MIX)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), **PACK)


STAGES = [("toxicity", toxicity), ("simhash", near_duplicates), ("substrings", repeated_passages), ("mixing", mixture), ("packing", sequences)]

#: A trained score, a 64-bit hash and a tokenizer have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
