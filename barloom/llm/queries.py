"""Registered queries of the training-data operators and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from . import licenses, line_quality, mixing, negatives, packing, quality, simhash, spelling, substrings, token_counts, toxicity, vectors, warc

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Levels of the mixing tree: a source's domain is given by its number.
LEVELS = {"domain": "CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint) IS NULL THEN 'other' ELSE concat('d', try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint) % 4) END",
          "lang": "lang", "source": "source"}
#: Target weights by path; nodes that are not named weigh 1.
WEIGHTS = {("d0",): 3, ("d1",): 2, ("d2",): 2, ("d0", "en"): 4, ("d1", "en"): 3, ("d2", "de"): 2, ("d3", "en"): 2, ("d0", "en", "src0"): 3, ("d1", "en", "src5"): 2}
MIX = {"share": 0.8, "epochs": 2, "seed": 17}


#: A text's first line is its prompt. A sequence takes 64 segments and leaves at least 64 tokens to prompts.
PACK = {"max_tokens": 4096, "max_segments": 64, "max_loss": 4032, "prompts": True}


@query
def op1_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"), {n: F.expr(e) for n, e in LEVELS.items()}, WEIGHTS, **MIX)


SQL["op1_mixing"] = mixing.mixing_sql(LEVELS, WEIGHTS, **MIX)


@query
def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_warc(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    # A record that does not read back is a fault of this run, not a page to leave out.
    checked = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "fault"))).otherwise(F.col("payload_bytes"))
    return records.select(warc.page_number("record_id").alias("page_id"), checked.cast("long").alias("payload_bytes"), "payload_digest",
                          "record_type", warc.page_number("refers_to").alias("refers_to"))


@query
def op4_substrings(spark, sf_dir):
    kept = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), **PACK)


@query
def op6_quality(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return quality.judged(table(spark, sf_dir, "documents"), trusted)


@query
def op7_simhash(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_line_quality(spark, sf_dir):
    return line_quality.line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_spelling(spark, sf_dir):
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


@query
def op13_negatives(spark, sf_dir):
    return negatives.mined(negatives.relabelled(table(spark, sf_dir, "embeddings")))


SQL["op13_negatives"] = negatives.MINED_SQL
