"""Benchmark decontamination by a prefix-filtered join of word windows, in DataFrame functions only.

A window is `WINDOW` consecutive words of an item, or a whole shorter item. Containment asks for all words of a
window, so its necessary prefix is one word: its rarest by count over the whole corpus. Words of the documents
meet windows on that word alone. The word's place in the window fixes the start; windows that would begin before
or end after the text are cut by length, and the words of the remaining places are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable, fits_broadcast, lower_ascii, sized, words_between

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return words_between(lower_ascii(text), SEPARATORS)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) to distinct (item_id, gram). Items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    return (items.withColumn("size", size).withColumn("start", F.explode(starts))
            .select("item_id", F.slice("w", F.col("start"), F.col("size")).alias("gram")).distinct())


def probes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram_id, gram) to the word that each gram is looked up by: word, gram_id, gram, size, offset.

    Words are counted over all documents. A gram with a word that no document has cannot occur and is left out.
    """
    places = durable(grams.select("gram_id", F.posexplode("gram").alias("offset", "word")))
    vocabulary = sized(places.select("word").distinct(), 64)
    counts = (docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(vocabulary, "word")
              .groupBy("word").count())
    ranked = places.join(counts, "word", "left").groupBy("gram_id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "offset")).alias("first"))
    return grams.join(ranked.where("first.count > 0"), "gram_id").select(
        F.col("first.word").alias("word"), "gram_id", "gram", F.size("gram").alias("size"),
        F.col("first.offset").alias("offset"))


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted spans (start, end), end exclusive."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(state: Column, span: Column) -> Column:
        fresh = F.greatest(span["end"] - F.greatest(span["start"], state["end"]), F.lit(0))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], span["end"]).alias("end"))
    return F.aggregate(spans, zero, add)["n"]


def _met(texts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Places of (doc_id, text_key, w) where a looked-up window stands: doc_id, text_key, gram_id, pos, offset, size.

    With a small lookup the words of a text stay where they are and are only referred to. A large one is joined by
    shuffle: then each row takes along no more than the words that a window around its place can reach, and only words
    that begin some lookup go.
    """
    words = texts.select("doc_id", "text_key", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    if fits_broadcast(lookup, 100):
        here = F.slice("w", start + 1, F.col("size"))
        met = words.join(F.broadcast(lookup), "word").where(inside & (here == F.col("gram")))
    else:
        first = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
        narrow = words.select("doc_id", "text_key", "n_words", "pos", "word", first.alias("first"),
                              F.slice("w", first + 1, F.lit(2 * WINDOW - 1)).alias("near"))
        narrow = narrow.join(sized(lookup.select("word").distinct(), 64), "word", "left_semi")
        here = F.slice("near", start - F.col("first") + 1, F.col("size"))
        met = narrow.join(lookup, "word").where(inside).where(here == F.col("gram"))
    return met.select("doc_id", "text_key", "gram_id", "pos", "offset", "size")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, text) to doc_id, text_key, n_words, n_hit, n_items, item_ids, spans.

    One row per row of `docs`; repeated rows give equal results. A null or empty text has no words and no hit;
    a null item id counts as the empty string. `spans` are the hit word ranges (start, end), null without hits.
    Other columns are left out. Empty tables on either side are allowed.
    """
    key = F.xxhash64("text").alias("text_key")
    pairs = item_windows(benchmark.select("item_id", "text"))
    pairs = durable(pairs)
    grams = durable(pairs.select("gram").distinct().withColumn("gram_id", F.monotonically_increasing_id()))
    lookup = durable(probes(docs, grams))
    items = sized(pairs.join(grams, "gram").select(
        "gram_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")), 64)

    texts = docs.select("doc_id", key, words_of(F.col("text")).alias("w"))
    met = _met(texts, lookup)
    start = F.col("pos") - F.col("offset")
    hits = durable(met.select("doc_id", "text_key", "gram_id", start.alias("start"),
                              (start + F.col("size")).alias("end")))
    spans = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    named = (hits.select("doc_id", "text_key", "gram_id").distinct().join(items, "gram_id")
             .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    found = durable(spans.join(named, same(spans, named)).select(
        spans["doc_id"].alias("found_id"), spans["text_key"].alias("found_key"), "spans", "item_ids"))
    rows = docs.select("doc_id", key, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["found_id"])
                     & (rows["text_key"] == found["found_key"]), "left")
    return both.select(
        "doc_id", "text_key", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans")
