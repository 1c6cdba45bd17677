"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import bpe, exact_dedup, html, jaccard, langid, packing, pii, quality, toxicity, urls
from gleanframe.llm.queries import URL_RULES, VOCABULARY

LONG = "word " * 60_000
TEXTS = [
    (1, "Same text here, with enough words to count."), (2, "same TEXT here, with enough words to count."), (3, None), (4, ""),
    (5, " \n\t "), (6, LONG), (7, "x"), (8, "¡ß漢😀"), (8, "¡ß漢😀"), (None, "no id"), (9, "a" * 30_000), (10, "0\0zero"),
]
# names that operators use inside, and columns of results
EXTRA = ["id", "n", "row", "kept", "score", "text_sha256", "length", "list", "component", "c0", "__t", "__key"]


def rows(spark, data=TEXTS):
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


def languages(df):
    return langid.predict(df, langid.fit(df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a"))))


def toxic(df):
    labels = df.select("doc_id", (F.col("doc_id") == 7).cast("int").alias("toxic"))
    return toxicity.score(df, toxicity.fit(df, labels))


APPLIED = {
    "html": lambda df: html.extract_text(df, key="doc_id", html="text", carry=("score",)),
    "toxicity": toxic,
    "pii": lambda df: pii.pseudonymise(df, b"k"),
    "langid": languages,
    "urls": lambda df: urls.judge_urls(df, URL_RULES, key="doc_id", url="text"),
    "dedup": exact_dedup.exact_groups,
    "bpe": lambda df: bpe.encode(df, VOCABULARY),
    "quality": quality.clean_lines,
    "jaccard": jaccard.similar_classes,
}


@pytest.mark.parametrize("name", APPLIED)
def test_one_row_each(spark, name):
    got = APPLIED[name](rows(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in TEXTS)


@pytest.mark.parametrize("name", APPLIED)
def test_empty_table(spark, name):
    assert APPLIED[name](rows(spark, [])).count() == 0


def test_packing_places_every_piece(spark):
    df = rows(spark)
    got = packing.pack(packing.token_pieces(df, VOCABULARY, capacity=512), capacity=512).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in TEXTS}
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack(packing.token_pieces(rows(spark, []), VOCABULARY)).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = rows(spark).withColumn("lang", F.lit("a"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_null_results(spark):
    df = rows(spark)
    by = {r["doc_id"]: r for r in exact_dedup.exact_groups(df).where("doc_id IS NOT NULL").collect()}
    assert by[1]["keep_id"] == 2 and not by[1]["kept"] and by[2]["kept"] and by[2]["group_size"] == 2
    assert by[3]["keep_id"] == by[4]["keep_id"] == 4
    kept = [r["kept"] for r in exact_dedup.exact_groups(df).where("doc_id = 8").collect()]
    assert sorted(kept) == [False, True]
    lang = {r["doc_id"]: r for r in languages(df).where("doc_id IS NOT NULL").collect()}
    assert lang[3]["lang_pred"] == lang[5]["lang_pred"] == "und" and lang[3]["score"] == 0
    near = {r["doc_id"]: r for r in jaccard.similar_classes(df).collect()}
    assert near[2]["component_id"] == 1 and near[4]["component_id"] == 4 and near[4]["n_shingles"] == 0
    assert near[None]["component_id"] is None
    hidden = {r["doc_id"]: r for r in pii.pseudonymise(df, b"k").collect()}
    assert hidden[3]["text"] is None and hidden[3]["spans"] == []
    clean = {r["doc_id"]: r for r in quality.clean_lines(df).collect()}
    assert clean[3]["n_words"] == 0 and clean[3]["base_failed"] and clean[6]["n_repeat_words"] == 60_000
