"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations.

A benchmark window (ten consecutive words of an item; a shorter item is one
window) must be wholly contained in a document, so one token of it is a
necessary prefix.  Tokens are ordered by rarity over all documents and the
rarest token of a window is its prefix.  Document tokens join the prefixes; the
window's length and the token's position in it bound where it could lie, and the
words there are compared exactly.

The prefix table is broadcast only while its measured size is below
``broadcast_bytes``; above that, tokens and documents are joined by shuffles.

Edge cases: null or wordless texts have no words and no hits; items without
words have no window; empty tables on either side give no hits; repeated
documents are rows of their own, repeated items and windows count once per
item_id; null item_ids are left out of the list of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Everything but ASCII letters, ASCII digits and non-ASCII characters.
DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words of a text in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), DELIMITERS), "")


def ascii_lower(words: Column) -> Column:
    """Lower-case A-Z of every word."""
    return F.transform(words, lambda w: F.translate(w, _UPPER, _LOWER))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (win array, items array of item_id as string).

    ``items`` grows only with repeats of one window over benchmark items."""
    words = items.select(F.col("item_id").cast("string").alias("item"), ascii_lower(raw_words(F.col("text"))).alias("w"))
    words = words.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = words.select("item", "w", F.explode(starts).alias("at")) \
        .select("item", F.slice("w", F.col("at"), window).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def token_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """Occurrences over all documents of the tokens in ``vocabulary``."""
    tokens = docs.select(F.explode(raw_words(F.col("text"))).alias("w")).select(F.lower("w").alias("token"))
    return (tokens.join(F.broadcast(vocabulary) if small else vocabulary, "token")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, offset, win, items): the rarest token of each window and where in
    the window it stands (equally rare: the smaller token, its first place)."""
    each = windows.select("win", "items", F.posexplode("win").alias("offset", "w")).select(
        "win", "items", "offset", F.lower("w").alias("token"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
    return (each.join(counts, "token", "left").groupBy("win", "items").agg(best.alias("m"))
            .select(F.col("m.token").alias("token"), F.col("m.offset").alias("offset"), "win", "items"))


def hits(docs: DataFrame, prefix: DataFrame, small: bool) -> DataFrame:
    """(rid, doc_id, tie, n_words, at, len, items): the occurrences of windows, and
    one row per document with null ``at`` that carries its number of words."""
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("tie"),
                        raw_words(F.col("text")).alias("words"))
    begin = F.col("pos") - F.col("offset")
    fits = (begin >= 0) & (begin + F.size("win") <= F.size("words"))
    # Compared as joined strings (words hold no blank), so that the scan stays one compiled stage.
    there = F.translate(F.array_join(F.slice("words", begin + 1, F.size("win")), " "), _UPPER, _LOWER)
    same = there == F.array_join("win", " ")
    out = ["rid", "doc_id", "tie", F.size("words").cast("bigint").alias("n_words"),
           F.when(F.col("win").isNotNull(), begin).alias("at"), F.size("win").alias("len"), "items"]
    if small:
        # An empty token after the last word meets the empty prefix: every document keeps one row.
        mark = docs.sparkSession.range(1).select(
            F.lit("").alias("token"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("win"),
            F.lit(None).cast("array<string>").alias("items"))
        tokens = texts.select("rid", "doc_id", "tie", "words",
                              F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "w"))
        found = tokens.join(F.broadcast(prefix.union(mark)), F.lower("w") == F.col("token"))
        return found.where(F.col("win").isNull() | (fits & same)).select(*out)
    tokens = texts.select("rid", F.posexplode("words").alias("pos", "w")).select("rid", "pos", F.lower("w").alias("token"))
    found = tokens.join(prefix, "token").where(begin >= 0).join(texts, "rid").where(fits & same).select(*out)
    return found.unionByName(texts.select(
        "rid", "doc_id", "tie", F.size("words").cast("bigint").alias("n_words"), F.lit(None).cast("int").alias("at"),
        F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted), spans
    (merged word ranges ``start, end`` covered by windows), contaminated and tie
    (hash of the text)."""
    windows = item_windows(items.select("item_id", "text"), window).cache()
    measured = windows.agg(F.sum(F.length(F.concat_ws(" ", "win")) + F.length(F.concat_ws(" ", "items")) + 64)).first()[0]
    small = (measured or 0) <= broadcast_bytes
    vocabulary = windows.select(F.explode("win").alias("w")).select(F.lower("w").alias("token")).distinct()
    counts = token_counts(docs, vocabulary, small)
    prefix = prefixes(windows, counts)
    found = hits(docs.select("doc_id", "text"), prefix, small)
    # Merge overlapping windows: a window adds what lies beyond the furthest end before it.
    w = Window.partitionBy("rid").orderBy(F.col("at").asc_nulls_first(), "len") \
        .rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("len")
    found = found.withColumn("reach", F.coalesce(F.max(end).over(w), F.lit(0)))
    found = found.withColumn("new", F.greatest(end - F.greatest("at", "reach"), F.lit(0)))
    item_list = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    spans = F.array_sort(F.collect_list(F.when(F.col("new") > 0, F.struct(
        F.greatest("at", "reach").alias("start"), end.alias("end")))))
    per = found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("tie").alias("tie"), F.max("n_words").alias("n_words"),
        F.coalesce(F.sum("new"), F.lit(0)).cast("bigint").alias("n_hit"),
        item_list.alias("items"), spans.alias("spans"))
    return per.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "spans",
                      (F.col("n_hit") > 0).alias("contaminated"), "tie")
