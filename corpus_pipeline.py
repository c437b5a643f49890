"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

What all stages do with odd rows: columns beyond those named pass as they are, whatever they are called; rows that repeat are
judged each by its own text; a null doc_id is no reason to go; an empty table gives an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, jaccard_join, language_id, secret_scan, sentence_pieces, shared

#: A text whose main language has a smaller share than this is no text of any language.
LEAST_SHARE = 0.3
#: A text whose bytes are less likely than those of its languages' learned texts by more than this (in nats, on average) is in
#: none of the learned languages.
LEAST_FIT = -1.25


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of doc_id and text, 64 bits, and the key's name. Rows share one if they are alike in both, or by a
    chance of 2**-64 for any two."""
    key = shared.free_name(docs, "row_key")
    return docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"))), key


def _by_keys(keyed: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose key is among keys, a table of one column (left_semi), or isn't (left_anti)."""
    other = shared.free_name(keyed, "other_key")
    return shared.by_ids(keyed, keys.toDF(other), F.col(key) == F.col(other), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, empty and letterless ones, mixtures without a main language, and texts that
    are unlike all learned languages (gibberish, other languages). Models are learned from the rows with lang; where none has
    one, nothing can be judged and all rows stay. Repeated rows have one verdict; equal shares go to the first language."""
    models = language_id.learn(docs)
    if not models.langs:
        return docs
    names = [f"in_{i}" for i in range(len(docs.columns))]  # no output is called so
    renamed, of = docs.toDF(*names), dict(zip(docs.columns, names, strict=True))
    judged = language_id.predict(renamed, models, doc_id=of["doc_id"], text=of["text"], carry=tuple(names), fit=True)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("fit") >= LEAST_FIT))
    return kept.select(*(F.col(n).alias(c) for c, n in of.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 percent of their five-word shingles, directly or through others, one row
    stays: that with the smallest doc_id (rows without one only if none has one), of several the one with the smallest key
    of its text, of rows alike in doc_id and text any one. Rows in no group stay, and so do null and blank texts, which are
    like no other."""
    keyed, key = _keyed(docs)
    folder = shared.shared_dir(spark)
    groups = jaccard_join.similar_groups(keyed, shingle=5, percent=80, carry=(key,)).where("n_shingles > 0").withColumnRenamed(key, "key")
    first = F.expr("doc_id <=> component_id")
    by_key = groups.where(first).groupBy("group", "key").agg(F.count("*").alias("n"))  # doc_ids may repeat in a group
    heads = by_key.groupBy("group").agg(F.min("key").alias("head"), F.count("*").alias("keys"), F.min_by("n", "key").alias("n"))
    heads = shared.written(heads.where("keys > 1 or n > 1"), folder, "heads")
    others = by_key.join(heads.select("group", "head"), "group").where("key <> head").select("key")
    twice = heads.where("n > 1").select(F.col("head").alias("gone"))
    gone = groups.where(~first).select("key").unionByName(others).select(F.col("key").alias("gone")).distinct()
    gone = shared.written(gone.unionByName(twice), folder, "gone")
    stay = _by_keys(keyed, key, gone, "left_anti")
    if not twice.isEmpty():
        stay = stay.unionByName(_by_keys(keyed, key, twice, "left_semi").dropDuplicates([key]))
    return stay.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows of 13 words cover 5 percent or more. Null and wordless texts have no words
    that are covered and stay; equal texts have one verdict."""
    keyed, key = _keyed(docs)
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=13, percent=5, carry=(key,))
    gone = shared.written(found.where("contaminated").select(F.col(key).alias("gone")).distinct(), shared.shared_dir(spark), "gone")
    return _by_keys(keyed, key, gone, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows. Documents without secrets stay as they are, null texts and null n_chars
    among them; no row goes."""
    found = shared.free_name(docs, "found")
    scanned = secret_scan.scan(docs, secret_scan.learn(secret_scan.samples(docs)), found=found)
    hit = F.size(found) > 0
    text = F.when(hit, secret_scan.redacted(F.col("text"), F.col(found))).otherwise(F.col("text"))
    done = scanned.withColumn("text", text)
    return done.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, of repeated rows each; a null or empty text is the end id alone, a null
    doc_id stays null."""
    coded = sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]
#: Language models and pieces are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are a table in the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = shared.written(stage(spark, docs, sf_dir), folder, f"{i}_{name}")
        if i:
            shared.forget(spark, folder, f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
