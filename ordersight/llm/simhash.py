"""Near duplicates by 64-bit SimHash with a table of distances to pivots.

Texts with equal fingerprints are one node. Two fingerprints are linked at `DISTANCE` or fewer differing bits,
and no link is lost: of six bit blocks at least three agree between them, so they meet under one of the twenty
keys that keep three blocks. Inside a key, the Hamming distances of every fingerprint to the pivots are computed
once; a pair whose coordinates differ by more than `DISTANCE` at any pivot is discarded (triangle inequality),
and the survivors are verified by counting bits. Distances to pivots alone give no key to join on: they gather
around 32 for any two fingerprints, so one pivot discards only about half of the pairs.

A key with more than `BUCKET` fingerprints is split again over the bits on which its members may still differ,
by the same rule. After three levels nine bits are free at most, so no bucket can hold more than `BUCKET`, and
nothing is capped. A bucket emits the links of a spanning star, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable, sized, texts
from ordersight.llm.components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
BUCKET = 512
LEVELS = 3
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, dtype=np.uint64, endpoint=False)
PAIRS_AT_ONCE = 2_000_000

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles; repeats count. No words: 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the white space \x20 \x09-\x0D
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=False)]
    h = np.array(hashes, np.uint64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS_OF_BYTE).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "text_key", "fp"])


def _keep_masks(free: int) -> list[int]:
    """Masks that keep three of the six blocks of the free bits; all bits that are not free are kept."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(bits, 6)]
    fixed = (1 << 64) - 1 - free
    return [fixed | sum(some) for some in combinations(blocks, 3)]


def _masks(level: int) -> np.ndarray:
    """All masks of a level, twenty after each mask of the level above, in its order."""
    everything = (1 << 64) - 1
    above = [0] if level == 0 else [int(m) for m in _masks(level - 1)]
    return np.array([m for a in above for m in _keep_masks(everything - a)], np.uint64)


def _keys(level: int):
    """(mask_no, fp) to twenty rows (mask_no, key, fp) of the level."""
    masks = _masks(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = batch.column(0).to_numpy().astype(np.int64)
            fp = np.repeat(batch.column(1).to_numpy().astype(np.int64), 20)
            number = (above[:, None] * 20 + np.arange(20)).ravel()
            key = (fp.view(np.uint64) & masks[number]).view(np.int64)
            yield pa.record_batch([pa.array(number), pa.array(key), pa.array(fp)], ["mask_no", "key", "fp"])
    return run


def _star(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of verified pairs, reduced to one link from each member to the least position it reaches."""
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(fp)))
            return fp[label[moved]], fp[moved]
        label = new


def near_pairs(fp: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within `DISTANCE` inside each of the consecutive groups of the given sizes."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    later = ends - np.arange(len(fp)) - 1
    i = np.repeat(np.arange(len(fp)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    for at in np.bitwise_count(fp.view(np.uint64)[None, :] ^ PIVOTS[:, None]).astype(np.int8):
        near = np.abs(at[i] - at[j]) <= DISTANCE
        i, j = i[near], j[near]
    near = np.bitwise_count(fp.view(np.uint64)[i] ^ fp.view(np.uint64)[j]) <= DISTANCE
    return i[near], j[near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        fp = np.ascontiguousarray(lists.flatten().to_numpy(), np.int64)
        part = (np.cumsum(sizes * sizes) // (2 * PAIRS_AT_ONCE))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            some = fp[offsets[own[0]]:offsets[own[-1] + 1]]
            a, b = _star(some, *near_pairs(some, sizes[own]))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(fp) distinct to links (a, b) that connect what any chain of near fingerprints connects."""
    rows = prints.select(F.lit(0).cast("long").alias("mask_no"), "fp")
    found = None
    for level in range(LEVELS):
        keys = rows.mapInArrow(_keys(level), "mask_no long, key long, fp long")
        sizes = sized(keys.groupBy("mask_no", "key").count().where("count > 1"), 24)
        met = durable(keys.join(sizes, ["mask_no", "key"]))
        small = met.where(F.col("count") <= BUCKET).groupBy("mask_no", "key").agg(F.collect_list("fp").alias("fps"))
        some = small.select("fps").mapInArrow(_links, "a long, b long").distinct()
        found = some if found is None else found.union(some)
        rows = met.where(F.col("count") > BUCKET).select("mask_no", "fp")
        if level == LEVELS - 1 or rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row per row: doc_id, text_key, fp, component_id, in_component (its rows), component.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. The
    component id is the smallest id reachable; null ids are passed over, and only a component without any id
    has a null one. `component` tells components apart even so. Repeated rows are repeated. Other columns are
    left out; an empty table gives an empty one.
    """
    prints = durable(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
                     .mapInArrow(_fingerprints, "doc_id long, text_key long, fp long"))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("in_component"))
    classes = durable(grouped.select("fp", "root").join(named, "root").withColumnRenamed("root", "component"))
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id", "in_component", "component")


def text_links(found: DataFrame) -> DataFrame:
    """From near_duplicates to links (a, b) of text keys: every text of a component to its least key."""
    texts_of = durable(found.select("component", "text_key").distinct())
    least = texts_of.groupBy("component").agg(F.min("text_key").alias("a"))
    return texts_of.join(least, "component").where("a <> text_key").select("a", F.col("text_key").alias("b"))


def superfluous(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From near_duplicates to the (doc_id, text_key) that go, and those kept ones of which all rows but one go.

    The row with the least id of a component stays, null ids last.
    """
    some = found.where("in_component > 1").select(
        "component", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key").alias("row"))
    some = durable(some.join(some.groupBy("component").agg(F.min("row").alias("best")), "component"))
    gone = some.where("row <> best").select("row.doc_id", "row.text_key").distinct()
    twice = some.where("row = best").groupBy("row.doc_id", "row.text_key").count().where("count > 1").drop("count")
    return gone, twice


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
