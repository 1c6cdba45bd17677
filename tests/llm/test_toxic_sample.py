"""Near copies of labelled texts count once, unrelated texts that share common words all count."""

import random

from pyspark.sql import functions as F

from gleanframe.llm import toxicity


def test_only_copies_are_dropped(spark):
    draw = random.Random(5)
    prose = [" ".join(["we are", *(f"w{draw.randrange(5000)}" for _ in range(40))]) for _ in range(200)]
    short = ["you are here", "they are there", "are", "", None]
    copies = [prose[0].upper(), prose[1].replace(" ", "  "), prose[2] + "\n", "You ARE here"]
    df = spark.createDataFrame(list(enumerate(prose + short + copies)), "key bigint, text string").withColumn("y", F.lit(False))
    got = [r["text"] or "" for r in toxicity._without_copies(df).collect()]
    assert sorted(got) == sorted(set(prose + short[:4]))
    # the same text under the other label is not a copy
    both = df.unionByName(df.withColumn("y", F.lit(True)))
    assert toxicity._without_copies(both).count() == 2 * len(got)


def test_texts_of_the_tables_are_fitted(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").dropna(subset=["doc_id", "toxic"])
    rows = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id")
    rows = rows.select(F.col("doc_id").alias("key"), "text", (F.col("toxic") > 0).alias("y"))
    kept = {r["y"]: r["count"] for r in toxicity._without_copies(rows).groupBy("y").count().collect()}
    there = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.countDistinct(F.lower("text")).alias("n")).collect()}
    print("kept", kept, "distinct", there)
    assert all(kept[y] > 0.8 * there[y] for y in there)
