"""Near duplicates are looked up in blocks of rows; texts are not shuffled to be chosen."""

import re

from barloom.llm import simhash


def _docs(spark):
    """3,000 different texts and 500 copies, with columns named like the stage's own."""
    rows = spark.range(0, 3500, 1, 3).selectExpr("id AS doc_id", "id % 3000 AS n")
    text = "concat_ws(' ', transform(sequence(1, 12), i -> concat('w', xxhash64(n, i)))) AS text"
    return rows.selectExpr("doc_id", text, "n AS _found", "n AS _least", "n AS _row", "n AS _block", "n AS row", "n AS root")


def test_chosen_rows_come_from_their_blocks(spark):
    docs = _docs(spark)
    out = simhash.one_per_group(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect()) == sorted(docs.filter("doc_id < 3000").collect())


def test_no_text_is_shuffled_to_be_chosen(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.one_per_group(_docs(spark))._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any("text#" in columns for columns in moved)
