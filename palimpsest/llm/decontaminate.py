"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every window of an item (so many words in a row; a shorter item whole) must occur word for word. Words are ordered by how
many documents hold them, rarest first; a window that is contained whole has its rarest word in the document, so its prefix
is that one word. Documents are searched for prefix words, each place found is joined with the windows of that word, and
the window is verified word by word at the place its prefix word dictates (position bound: it can't begin before the text
or, length bound, end after it)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import shared

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: So many different words may be written into a plan as a set; beyond, they are joined.
MOST_LITERALS = 20_000
#: Windows of one prefix word that a row holds.
MOST_WINDOWS = 64


def words(text: Column) -> Column:
    """The words of a text, as they are written."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A-Z as a-z."""
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def _windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """words (lower case), items: each distinct window and the ids of the items that have it."""
    w = items.select(F.col(item_id).cast("string").alias("item"), F.transform(words(F.col(text)), lowered).alias("w")).where(F.size("w") > 0)
    starts = F.expr(f"sequence(1, greatest(size(w) - {size - 1}, 1))")
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items"))


def _found(held: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """held: rid, words; wanted: word. rid and the places (from 0) of words whose small-letter form is wanted."""
    some = [r[0] for r in wanted.limit(most + 1).collect()]
    if len(some) <= most:
        hit = lambda w, i: F.when(F.lower(w).isin(some), i) if some else F.lit(None).cast("int")
        return held.select("*", F.filter(F.transform("words", hit), lambda x: x.isNotNull()).alias("places"))
    each = held.select("rid", F.posexplode("words").alias("place", "w")).join(wanted, F.lower("w") == F.col("word"), "left_semi")
    return held.join(each.groupBy("rid").agg(F.collect_list("place").alias("places")), "rid")


def contamination(
    docs: DataFrame, items: DataFrame, *, size: int = 13, percent: int = 5, most_literals: int = MOST_LITERALS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (array, sorted as strings), contaminated and the columns carry (small ones), for every
    row of docs.

    Words are runs of ASCII letters (A-Z as a-z), digits and other than ASCII characters. A word inside any occurrence of a
    window is hit; a document is contaminated if words are hit and they are percent of its words or more. Defined results:
    null, empty and wordless texts have no words and no hits; wordless items have no window; an item without an id hits
    words but isn't listed; equal items are both listed; a null doc_id stays null and repeated rows are judged each; empty
    tables give no rows or no hits; other columns are ignored; texts are read whole."""
    spark = docs.sparkSession
    folder = shared.shared_dir(spark)
    windows = shared.written(_windows(items, size, item_id, item_text), folder, "windows")
    carried = {f"c{i}": c for i, c in enumerate(carry)}
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("words"), *(F.col(c).alias(n) for n, c in carried.items()))

    # how many documents hold each word of the items
    vocabulary = windows.select(F.explode(F.transform("words", F.lower)).alias("word")).distinct()
    known = [r[0] for r in vocabulary.limit(most_literals + 1).collect()]
    held_words = F.array_distinct(F.filter(F.transform("words", F.lower), lambda w: w.isin(known) if known else F.lit(False)))
    if len(known) <= most_literals:
        seen = read.select(F.explode(held_words).alias("word"))
    else:
        seen = read.select(F.explode(F.array_distinct(F.transform("words", F.lower))).alias("word")).join(vocabulary, "word", "left_semi")
    counts = shared.written(seen.groupBy("word").agg(F.count("*").alias("held_by")), folder, "counts")

    # each window's prefix: its rarest word, at its first place in the window; windows with a word that none holds can't occur
    places = windows.select(F.xxhash64("words").alias("h"), "words", "items", F.posexplode("words").alias("place", "w")).withColumn("word", F.lower("w"))
    ranked = places.join(counts, "word", "left").withColumn("r", F.row_number().over(Window.partitionBy("h", "words").orderBy(F.col("held_by").asc_nulls_first(), "word", "place")))
    prefixes = ranked.where("r = 1 and held_by is not null").select("word", F.struct(F.col("place").alias("at"), "words", "items").alias("win"))
    some = F.floor((F.row_number().over(Window.partitionBy("word").orderBy("win")) - 1) / MOST_WINDOWS)  # a common word's windows are several rows
    prefixes = shared.written(prefixes.withColumn("some", some).groupBy("word", "some").agg(F.collect_list("win").alias("wins")).drop("some"), folder, "prefixes")
    sought = prefixes.select("word").distinct()

    held = read.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "words", *carried)
    reach = size - 1
    if sought.count() > most_literals:
        held = shared.written(held, folder, "held")  # row ids must be the same in both readings
        placed = held.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), *carried).join(_found(held, sought, most_literals).select("rid", "words", "places"), "rid", "left")
    else:
        placed = _found(held, sought, most_literals).withColumn("n_words", F.size("words").cast("long"))
    around = lambda i: F.struct(
        i.alias("place"), F.greatest(i - reach, F.lit(0)).alias("base"), F.lower(F.get("words", i)).alias("word"),
        F.transform(F.slice("words", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + size), lowered).alias("near"),
    )
    placed = placed.select("rid", "doc_id", "n_words", *carried, F.transform(F.coalesce("places", F.array().cast("array<int>")), around).alias("near"))
    placed = shared.written(placed, folder, "placed")

    near = placed.where(F.size("near") > 0).select("rid", F.explode("near").alias("n")).select("rid", "n.*")
    fits = lambda w: (F.col("place") >= w["at"]) & (F.slice("near", F.col("place") - w["at"] - F.col("base") + 1, F.size(w["words"])) == w["words"])
    hits = near.join(prefixes, "word").select("rid", "place", F.filter("wins", fits).alias("wins")).where(F.size("wins") > 0)
    span = lambda w: F.struct((F.col("place") - w["at"]).alias("s"), (F.col("place") - w["at"] + F.size(w["words"])).alias("e"))
    by_row = hits.groupBy("rid").agg(
        F.array_sort(F.flatten(F.collect_list(F.transform("wins", span)))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list(F.transform("wins", lambda w: w["items"])))))).alias("item_ids"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["e"] - F.greatest(s["s"], a["to"]), F.lit(0)).cast("long")).alias("n"), F.greatest(a["to"], s["e"]).alias("to"))
    by_row = by_row.select("rid", F.aggregate("spans", start, step)["n"].alias("n_hit"), "item_ids")
    out = placed.select("rid", "doc_id", "n_words", *carried).join(by_row, "rid", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((F.coalesce("n_hit", F.lit(0)) > 0) & (100 * F.coalesce("n_hit", F.lit(0)) >= percent * F.col("n_words"))).alias("contaminated"),
        *(F.col(n).alias(c) for n, c in carried.items()),
    )
    out = shared.written(out, folder, "out")
    shared.forget(spark, folder, "windows", "counts", "prefixes", "held", "placed")
    return out
