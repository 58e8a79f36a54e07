"""Importance resampling towards the texts of a target table, by hashed word n-grams.

The CRC of an n-gram is never computed from its bytes. A text is brought to one separator between words and scanned
once; the running CRC is kept at the end of every word. For bytes A and B, crc(AB) = crc(A) * x^(8 |B|) + crc(B) over
GF(2), so the CRC of any run of words is the running CRC at its end plus the shifted one at its beginning.

Odd rows: null and empty texts have no features and weight 0. A null id draws as the empty string. Repeated rows are
scored and ranked one by one, in any order among themselves. Columns of other names are not looked at; an empty table
gives no rows, and an empty target leaves the gains to the table alone.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable, texts

LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Features that are turned into buckets at once.
FEATURES_AT_ONCE = 1 << 20
#: The polynomial of CRC-32 with its bits reversed.
POLYNOMIAL = 0xEDB88320

#: Bytes of words stay, A-Z in lower case; every other byte is a space.
SEPARATED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
                  for b in range(256))


@cache
def shift_tables(k: int) -> np.ndarray:
    """The linear map that moves a CRC over 2^k zero bytes, as a table of 256 values for each of its four bytes."""
    if k:
        return shifted_once(shift_tables(k - 1), shift_tables(k - 1))
    tables = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])).astype(np.uint32)
    for _ in range(8):
        tables = (tables >> np.uint32(1)) ^ (tables & np.uint32(1)) * np.uint32(POLYNOMIAL)
    return tables


def shifted_once(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24])


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each CRC moved over its own number of zero bytes, one pass per binary digit of the numbers."""
    crc = crc.copy()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        moved = np.flatnonzero(n_bytes >> k & 1)
        crc[moved] = shifted_once(crc[moved], shift_tables(k))
    return crc


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SEPARATED).split()


def _running(crc: int, word: bytes) -> int:
    return crc32(word, crc)


def feature_crcs(documents: list[list[bytes]], longest: int = LONGEST):
    """Blocks (document numbers, CRCs) of the runs of 1 to `longest` words of every document, repeats included."""
    counts = np.array([len(w) for w in documents], np.int64)
    if not counts.sum():
        return
    joined = [w for own in documents for w in own]
    # One scan over all words. The separator in front of a word has its own running CRC, so that both the end of a
    # word (after it) and the beginning of the next one (after its separator) are prefixes.
    pieces = [p for w in joined for p in (b" ", w)]
    crcs = np.fromiter(accumulate(pieces, _running, initial=0), np.uint32, len(pieces) + 1)[1:]
    begin, end = crcs[0::2], crcs[1::2]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    ends = np.cumsum(sizes + 1)
    owner = np.repeat(np.arange(len(documents)), counts)
    for n in range(1, longest + 1):
        for lo in range(0, len(joined) - n + 1, FEATURES_AT_ONCE):
            first = np.arange(lo, min(lo + FEATURES_AT_ONCE, len(joined) - n + 1))
            first = first[owner[first] == owner[first + n - 1]]
            last = first + n - 1
            covered = ends[last] - ends[first] + sizes[first]
            yield owner[first], end[last] ^ shifted(begin[first], covered)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all rows; a partition sends at most one row per bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crcs in feature_crcs([words(t) for t in texts(batch)], longest):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most one row per bucket, whatever the size of the table
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed source share)) of every bucket."""
    everywhere, wanted = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * everywhere / ((s + 1.0) * wanted)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise of an id in thousandths, the same in every run."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, from one narrow pass."""
    def score(batches):
        for batch in batches:
            ids = batch.column(batch.schema.names.index("doc_id"))
            own = [words(t) for t in texts(batch)]
            n_words = np.array([len(w) for w in own], np.int64)
            weight = np.zeros(len(own), np.int64)
            for owner, crcs in feature_crcs(own, longest):
                np.add.at(weight, owner, gain[crcs % np.uint32(len(gain))])
            n_features = sum(np.maximum(n_words - n + 1, 0) for n in range(1, longest + 1))
            drawn = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.record_batch([ids, *map(pa.array, (n_words, n_features, weight, weight + drawn))],
                                  ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds `rank` to the highest scores among the rows of enough words; the others have null.

    The narrow rows are sorted over all executors by ranges of (score, id); a row's rank is the number of rows in the
    ranges before its own plus its place. Only one count per range reaches the driver.
    """
    rows = durable(rows)
    enough = F.col("n_words") >= least_words
    order = [enough.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = placed.withColumns({"_part": F.spark_partition_id(),
                                 "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["_part"]: (r["n"], r["eligible"]) for r in placed.groupBy("_part").agg(
        F.count("*").alias("n"), F.count_if(enough).alias("eligible")).collect()}
    taken = percent * sum(e for _, e in sizes.values()) // 100
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate((sizes[p][0] for p in parts), initial=0)))
    starts = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(parts, default=-1) + 1)]) if parts else F.array(F.lit(0).cast("long"))
    rank = F.get(starts, F.col("_part")) + F.col("_place") + 1
    return placed.withColumn("rank", F.when(enough & (rank <= taken), rank)).drop("_part", "_place")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT,
              least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of `docs`.

    A document weighs the sum over its features of the log ratio of their bucket's shares in `target` and in `docs`,
    in thousandths rounded down. Noise of its id makes the highest scores a draw without replacement by weight.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return drawn(scored(docs, gain, longest, seed), percent, least_words)
