"""The draw by hashed n-grams against CRCs of the bytes themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordersight.llm import queries, resampling

FOLDER = "/root/testdata/sf0.001"


def slow_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_features(text):
    w = slow_words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def slow(docs, target):
    """Rows by doc_id, and those drawn in order; `docs` are (doc_id, text) without repeats."""
    source, wanted = (Counter(c % 10000 for t in part for c in slow_features(t)) for part in ([t for _, t in docs], target))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    out, eligible = {}, []
    for doc_id, text in docs:
        features = slow_features(text)
        weight = sum(math.floor(1000 * math.log((wanted[c % 10000] + 1) * (s_all + 10000)
                                                / ((source[c % 10000] + 1) * (t_all + 10000)))) for c in features)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[doc_id] = [len(features), weight, score, None]
        if len(slow_words(text)) >= 20:
            eligible.append((-score, doc_id))
    for rank, (_, doc_id) in enumerate(sorted(eligible)[:len(eligible) * 5 // 100], 1):
        out[doc_id][3] = rank
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ09é .,\n😀\x7f", max_size=40), max_size=5))
def test_crcs_by_prefixes(texts):
    got = [[] for _ in texts]
    for owner, crcs in resampling.feature_crcs([resampling.words(t) for t in texts]):
        for o, c in zip(owner.tolist(), crcs.tolist()):
            got[o].append(c)
    assert [sorted(g) for g in got] == [sorted(slow_features(t)) for t in texts]


def test_long_words_are_shifted(monkeypatch):
    monkeypatch.setattr(resampling, "FEATURES_AT_ONCE", 7)
    text = " ".join("x" * n for n in (1, 70_000, 3, 255, 256, 257, 65_536, 1)) + " end"
    got = sorted(c for _, crcs in resampling.feature_crcs([resampling.words(text)]) for c in crcs.tolist())
    assert got == sorted(slow_features(text))


def test_query(spark):
    pd = pytest.importorskip("pandas")
    if not Path(FOLDER).exists():
        pytest.skip("no shared tables here")
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    target = pd.read_parquet(f"{FOLDER}/benchmark.parquet").text.tolist()
    rows = queries.op11_prefix_crc_resampling(spark, FOLDER).collect()
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in rows}
    want = slow(list(zip(docs.doc_id.tolist(), docs.text.tolist())), target)
    assert got == want and len(rows) == len(docs) and sum(v[3] is not None for v in want.values()) > 3


def test_odd_rows_ties_and_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    same = "tie " * 25
    texts = [(None, None), (1, ""), (2, " \n"), (3, same), (4, same), (4, same), *((k, f"{same} w{k}") for k in range(10, 90))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in texts],
                                 "doc_id long, text string, rank int, weight int, _part int, score string").repartition(5)
    target = spark.createDataFrame([("w7 w8",), (None,)], "text string")
    rows = resampling.resampled(docs, target).collect()
    assert len(rows) == len(texts) and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4]
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    others = [r["score"] for r in rows if not r["rank"] and r["n_words"] >= 20]
    assert [r["score"] for r in drawn] == sorted((r["score"] for r in drawn), reverse=True)
    assert min(r["score"] for r in drawn) >= max(others)
    empty = {r["doc_id"]: (r["n_features"], r["weight"], r["rank"]) for r in rows if r["n_words"] == 0}
    assert empty == {None: (0, 0, None), 1: (0, 0, None), 2: (0, 0, None)}
    assert resampling.resampled(docs.limit(0), target).count() == 0
    assert resampling.resampled(docs, target.limit(0)).count() == len(texts)


def test_equal_scores_go_by_id(spark):
    rows = spark.createDataFrame([(k, 30, 0, 0, 7) for k in range(100)],
                                 "doc_id long, n_words long, n_features long, weight long, score long").repartition(6)
    got = {r["doc_id"]: r["rank"] for r in resampling.drawn(rows).collect() if r["rank"]}
    assert got == {k: k + 1 for k in range(5)}


def test_shift_is_that_of_zero_bytes():
    crc = np.array([zlib.crc32(b"abc")] * 4, np.uint32)
    sizes = np.array([0, 1, 9, 4096])
    got = resampling.shifted(crc, sizes)
    for c, n in zip(got.tolist(), sizes.tolist()):
        tail = bytes(n)
        assert c ^ zlib.crc32(tail) == zlib.crc32(b"abc" + tail)
