"""Repeated passages of lines, by content-defined chunks of lines, in DataFrame functions only.

Each line is hashed. A chunk ends after a line whose hash is not divisible by `ALONE`, where a rolling hash over the
hashes of the last two lines is divisible by `TOGETHER`, and on both sides of a line of more than `PASSAGE_WORDS`
words. Boundaries depend on the lines around them alone, so lines put in front of a passage do not move those
inside it, and a passage of a few lines has boundaries of its own. Equal neighbours, other than such long lines, stay
together, so that a block of one line is compared as a whole.

Chunks whose 64-bit hash is met twice are grouped by their whole text, which compares the bytes; the first of them,
by doc_id, then place, is the origin. Every other one is extended over the equal lines at the end of the chunk before
and at the beginning of the chunk behind it, again by the lines themselves. Neighbouring lines that come from one
origin document at one shift are a run; a run goes if it has more than `PASSAGE_WORDS` words, and a chunk of several
lines goes in any case.

`without_passages` needs no boundaries: a passage of more than `PASSAGE_WORDS` words holds, from each of its lines
on, the shortest run of lines with more than so many words, forwards or backwards. Runs that were met before are
therefore all such passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable, sized, words_between

FACTOR = 31
ALONE = 4
TOGETHER = 3
#: Passages of one or more lines count from more words than these.
PASSAGE_WORDS = 50
#: Chunks of one line are looked for from so many words on.
ANCHOR_WORDS = 4


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def n_words(line: Column) -> Column:
    return F.size(words_between(line, r"[\x20\x09-\x0D]+"))


def chunked(docs: DataFrame) -> DataFrame:
    """Adds `text_key`, `lines`, `words` (per line) and `chunks`, an array of (first, size): places and numbers of lines."""
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    docs = docs.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    docs = docs.withColumn("hashes", F.transform("lines", line_hash)).withColumn("words", F.transform("lines", n_words))
    last = F.size("lines")

    def stops(i: Column) -> Column:
        h = F.element_at("hashes", i)
        before = F.when(i > 1, F.element_at("hashes", F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0))
        split = (h % ALONE != 0) | ((before * FACTOR + h) % TOGETHER == 0)
        return ((split & (F.element_at("lines", i) != F.element_at("lines", F.least(i + 1, last)))) | (i == last)
                | (F.element_at("words", i) > PASSAGE_WORDS)
                | (F.element_at("words", F.least(i + 1, last)) > PASSAGE_WORDS))
    docs = docs.withColumn("ends", F.filter(F.sequence(F.lit(1), last), stops))
    firsts = F.concat(F.array(F.lit(1)), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + 1))
    return docs.withColumn("chunks", F.zip_with(
        firsts, "ends", lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("size")))).drop("hashes", "ends")


def chunk_text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"], chunk["size"]), "\n")


def _equal(these: Column, those: Column) -> Column:
    """Number of lines that two arrays have in common at their beginnings."""
    pairs = F.arrays_zip(F.slice(these, F.lit(1), F.least(F.size(these), F.size(those))).alias("a"), those.alias("b"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(pairs, start, lambda s, p: F.when(s["on"] & p["a"].eqNullSafe(p["b"]), F.struct(
        (s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on"))))["n"]


def repeated(docs: DataFrame) -> DataFrame:
    """Places to remove: found_id, found_key, gone (numbers of lines of the row)."""
    cut = chunked(docs.select("doc_id", "text"))

    def side(c: Column) -> Column:
        # No line of a neighbour is carried that is a chunk by itself for its length: it needs no extension.
        lines = F.slice("lines", c["first"], c["size"])
        return F.when(F.element_at("words", c["first"]) <= PASSAGE_WORDS, lines).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    # Chunks get their texts in front of the explode, so that no row carries all lines of its document. The outer form
    # keeps the optimizer from asking for rows with chunks below the projections, where it hashes all lines per line.
    placed = F.transform("chunks", lambda c, k: F.struct(
        c["first"].alias("first"), c["size"].alias("size"), chunk_text(F.col("lines"), c).alias("chunk"),
        F.slice("words", c["first"], c["size"]).alias("words"),
        F.when(k > 0, F.reverse(side(F.element_at("chunks", F.greatest(k, F.lit(1)))))).otherwise(none).alias("before"),
        F.when(k + 1 < F.size("chunks"), side(F.element_at("chunks", F.least(k + 2, F.size("chunks"))))).otherwise(none).alias("behind")))
    rows = (cut.select("doc_id", "text_key", F.filter(placed, lambda c: (c["size"] > 1) | (c["words"][0] >= ANCHOR_WORDS)).alias("placed"))
            .select("doc_id", "text_key", F.inline_outer("placed")).where("first IS NOT NULL")
            .withColumn("chunk_key", F.xxhash64("chunk")))
    again = sized(rows.groupBy("chunk_key").count().where("count > 1").select("chunk_key"), 16)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "first")
    met = durable(rows.join(again, "chunk_key").withColumn("place", place))
    # Grouping by the text compares bytes; texts that only share their hash stay apart.
    origins = met.groupBy("chunk").agg(F.min(F.struct("place", "before", "behind")).alias("origin"))
    later = met.join(sized(origins, 64), "chunk").where(F.col("place") != F.col("origin")["place"])
    later = later.withColumn("up", _equal(F.col("before"), F.col("origin")["before"])).withColumn(
        "down", _equal(F.col("behind"), F.col("origin")["behind"]))
    words = F.concat(F.reverse(F.transform(F.slice("before", F.lit(1), F.col("up")), n_words)), F.col("words"),
                     F.transform(F.slice("behind", F.lit(1), F.col("down")), n_words))
    found = [F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")]
    at = F.col("origin")["place"]
    # Only numbers are shuffled here; a group holds lines of one document against one other.
    runs = durable(later.groupBy(*found, at["doc_id"].alias("origin_id"), at["text_key"].alias("origin_key"),
                                 (F.col("first") - at["first"]).alias("shift")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(words, lambda n, k: F.struct(
            (F.col("first") - F.col("up") + k).alias("i"), n.alias("n"))))))).alias("lines"),
        F.flatten(F.collect_list(F.when(F.col("size") > 1, F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)))).alias("gone")))
    keys = ["found_id", "found_key", "origin_id", "origin_key", "shift"]
    each = runs.select(*keys, F.posexplode("lines").alias("k", "line")).select(*keys, (F.col("line")["i"] - F.col("k")).alias("run"), "line.*")
    long = each.groupBy(*keys, "run").agg(F.sum("n").alias("n"), F.min("i").alias("a"), F.max("i").alias("b")).where(F.col("n") > PASSAGE_WORDS)
    gone = long.select("found_id", "found_key", F.sequence("a", "b").alias("gone")).unionByName(
        runs.where(F.size("gone") > 0).select("found_id", "found_key", "gone"))
    return durable(gone.groupBy("found_id", "found_key").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_lines, n_chunks, n_removed_lines, kept_text.

    Every removed line has an equal one at an earlier place. A null text is one empty line, which is kept. Rows with
    equal id and text are one occurrence and keep the same lines. Null ids come after all others in the order of
    occurrences. Other columns are left out; an empty table gives an empty one.
    """
    gone = repeated(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["found_id"]) & (rows["text_key"] == gone["found_key"]), "left")
    rows = chunked(rows.select("doc_id", "text", "gone"))
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("kept", kept)
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed_lines"),
        F.array_join(F.transform("kept", lambda i: F.element_at("lines", i)), "\n").alias("kept_text"))


def runs(docs: DataFrame) -> DataFrame:
    """Adds `text_key`, `lines` and `runs`, an array of (first, last, passage): shortest runs of over `PASSAGE_WORDS` words.

    A run starts and ends with a line that has words; lines of white space inside are left out of its passage.
    """
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    docs = docs.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    worded = F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), F.size(words_between(x, r"[\x20\x09-\x0D]+")).alias("n"), x.alias("line")))
    docs = docs.withColumn("worded", F.filter(worded, lambda x: x["n"] > 0))
    docs = docs.withColumn("words", F.transform("worded", lambda x: x["n"]))
    most, none = PASSAGE_WORDS + 1, F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"))

    def length(words: Column) -> Column:
        found = F.aggregate(words, none, lambda s, n: F.when(s["total"] > PASSAGE_WORDS, s).otherwise(
            F.struct((s["total"] + n).alias("total"), (s["n"] + 1).alias("n"))))
        return F.when(found["total"] > PASSAGE_WORDS, found["n"]).otherwise(0)

    def span(first: Column, n: Column) -> Column:
        return F.struct(first.alias("k"), n.alias("n"))
    # Every line has a word here, so no run is longer than `most` lines.
    places = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"))).otherwise(F.array().cast("array<int>"))
    on = F.transform(places, lambda k: span(k, length(F.slice("words", k, F.lit(most)))))
    back = F.transform(places, lambda k: span(k, length(F.reverse(F.slice("words", F.greatest(k - most + 1, F.lit(1)), F.least(k, F.lit(most)))))))
    back = F.transform(back, lambda x: span(x["k"] - x["n"] + 1, x["n"]))
    docs = docs.withColumn("spans", F.array_distinct(F.filter(F.concat(on, back), lambda x: x["n"] > 0)))
    return docs.withColumn("runs", F.transform("spans", lambda x: F.struct(
        F.element_at("worded", x["k"])["at"].alias("first"), F.element_at("worded", x["k"] + x["n"] - 1)["at"].alias("last"),
        F.array_join(F.transform(F.slice("worded", x["k"], x["n"]), lambda y: y["line"]), "\n").alias("passage")))
    ).drop("worded", "words", "spans")


def met_before(docs: DataFrame) -> DataFrame:
    """Places to remove: found_id, found_key, gone (numbers of lines inside runs that an earlier place has)."""
    cut = runs(docs.select("doc_id", "text"))
    rows = (cut.select("doc_id", "text_key", F.inline_outer("runs")).where("first IS NOT NULL")
            .withColumn("run_key", F.xxhash64("passage")))
    # Rows with equal id and text are one occurrence.
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "first", "last")
    again = sized(rows.groupBy("run_key").count().where("count > 1").select("run_key"), 16)
    met = durable(rows.join(again, "run_key").withColumn("place", place))
    origins = met.groupBy("passage").agg(F.min("place").alias("origin"))
    # A run that overlaps its own first occurrence, as in a block of one line, is a part of it.
    same = F.col("doc_id").eqNullSafe(F.col("origin")["doc_id"]) & F.col("text_key").eqNullSafe(F.col("origin")["text_key"])
    later = met.join(sized(origins, 600), "passage").where(~same | (F.col("first") > F.col("origin")["last"]))
    return durable(later.groupBy(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"))
                   .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last")))).alias("gone")))


def without_passages(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_lines, n_removed_lines, kept_text.

    Every line goes that lies in a passage of more than `PASSAGE_WORDS` words, of one or more lines, that an earlier
    place has (by doc_id, null ids last, then line; also in the same text, without overlap). The text of a removed line is kept at an
    earlier place. Rows with equal id and text keep the same lines. Other columns are left out; an empty table gives
    an empty one.
    """
    gone = met_before(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["found_id"]) & (rows["text_key"] == gone["found_key"]), "left")
    rows = rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("kept", kept)
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed_lines"),
        F.array_join(F.transform("kept", lambda i: F.element_at("lines", i)), "\n").alias("kept_text"))
