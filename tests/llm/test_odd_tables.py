"""Ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, html_extract, jaccard_join, language_id, quality_rules, secret_scan, sentence_pieces, shared, token_output, toxicity, warc

DOCS = "doc_id long, text string"


def three(spark, text, extra=()):
    """Rows that repeat, one without an id, one without a text."""
    return spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), *extra], DOCS).withColumn("words", F.lit("mine")).withColumn("node", F.lit(7)).withColumn("c0", F.lit(1))


def results(df, *drop):
    """The rows of one id, which must be alike, and how many rows there are."""
    rows = [tuple(r) for r in df.drop(*drop).collect()]
    alike = [r[1:] for r in rows if r[0] in (1, None)]
    assert all(a == alike[0] for a in alike)
    return len(rows)


def test_languages_of_equal_share_and_repeated_rows(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices(["ka", "ro", "mi"], k=3)) for _ in range(20)) for _ in range(30)]
    rows = [(2 * i + j, t, lang) for i, t in enumerate(texts) for j, lang in enumerate(("bb", "aa"))]
    models = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = language_id.predict(three(spark, texts[0]), models)
    assert results(told) == 4 and told.where("doc_id = 1").first()["lang_pred"] == "aa"
    assert language_id.predict(three(spark, texts[0]).limit(0), models).count() == 0


def test_repeated_rows_are_judged_each(spark):
    item = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(3, item), (3, item), (4, item)], "item_id long, text string")
    found = decontaminate.contamination(three(spark, f"a b {item} c"), items, carry=("c0",))
    assert results(found) == 4 and found.where("doc_id = 1").first()["item_ids"] == ["3", "4"] and found.where("c0 = 1").count() == 4
    coded = sentence_pieces.encode(three(spark, item), public_tokenizers.path("piece_bpe_32k.model"))
    assert results(coded) == 4
    assert results(quality_rules.judge(three(spark, item))) == 4
    groups = jaccard_join.similar_groups(three(spark, item, [(0, item + " more"), (9, "other")]), shingle=2, percent=80, carry=("node",))
    by = {(r["doc_id"], r["component_id"], r["node"]) for r in groups.collect()}
    assert groups.count() == 6 and by == {(1, 0, 7), (None, 0, 7), (2, 2, 7), (0, 0, 7), (9, 9, 7)}
    assert {r["group"] is None for r in groups.where("doc_id = 2").collect()} == {True} and groups.where("component_id = 0").select("group").distinct().count() == 1


def test_repeated_rows_in_files(spark):
    docs = three(spark, "some words here")
    read = token_output.read(token_output.write(docs, shared.shared_dir(spark), public_tokenizers.path("word_bpe_49k.json")))
    assert results(read, "start") == 4 and [r["start"] for r in read.orderBy("start").collect()] == [0, 4, 8, 12]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "words")
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.read(warc.write(pages, shared.shared_dir(spark))).collect())
    assert kinds == [(0, "revisit", 1), (1, "response", 0), (1, "revisit", 1), (2, "response", 0)]
    assert results(html_extract.main_texts(pages.withColumn("n_chars", F.lit("x")))) == 4


def test_repeated_rows_are_scored_alike(spark):
    blank = toxicity.learn(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, toxic int"))
    assert results(toxicity.score(three(spark, "some words"), blank)) == 4
    none = secret_scan.learn(secret_scan.samples(spark.createDataFrame([], DOCS)))
    assert results(secret_scan.scan(three(spark, "token=abcdefgh1"), none).select("doc_id", "text", "found").where("text is not null")) == 3
