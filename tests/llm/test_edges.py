"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordersight.llm import (common, components, cotraining, decontaminate, fertility, line_chunks, mixing, pii, sharding,
                            simhash, token_files, toxicity)
from ordersight.llm.queries import vocabulary

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, size string, fp int, "
          "word string, chunk int, key string, copies int")
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", None, 4), (3, LONG, "en", "a", 1),
            (4, "one line\nanother line\none line", "en", "b", 2), (4, "one line\nanother line\none line", "en", "b", 2),
            (5, "mail me at x.y@z.example.com or +1 (988) 555-2485 now", "de", "b", 3), (None, "no id here", None, "c", 9)]
    return spark.createDataFrame([(*r, 7, 7, "s", 1, "w", 1, "k", 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "One LINE"), (2, None), (None, "beta gamma"), (3, "")], "item_id long, text string")


def operators(labels, benchmark):
    sp, bpe = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
    return {
        "near": simhash.near_duplicates, "toxic": lambda d: toxicity.toxicity(d, labels),
        "quality": lambda d: cotraining.quality(d, labels), "mix": mixing.balanced, "mixed": mixing.mixed,
        "fertility": lambda d: fertility.quality(d, sp), "pii": pii.personal_data,
        "leaks": lambda d: decontaminate.contamination(d, benchmark), "tokens": lambda d: token_files.round_trip(d, bpe),
        "lines": line_chunks.deduplicated, "shards": sharding.sharded}


NAMES = ["near", "toxic", "quality", "mix", "mixed", "fertility", "pii", "leaks", "tokens", "lines", "shards"]


@pytest.mark.parametrize("name", ["near", "mix", "fertility", "leaks", "tokens", "lines"])
def test_no_broadcast_no_difference(spark, docs, labels, benchmark, name, monkeypatch):
    def rows():
        found = operators(labels, benchmark)[name](docs)
        return sorted(map(repr, found.select(*sorted(set(found.columns) - {"file_no", "path"})).collect()))
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_broadcast_is_measured(spark):
    """Two rows with long texts, plain or nested, are larger than many short ones."""
    few = spark.createDataFrame([(1, "x" * 10_000_000, ["y"]), (2, "", ["z" * 10_000_000])], "id long, t string, a array<string>")
    assert not common.fits_broadcast(few, 16) and common.fits_broadcast(few.select("id"), 16)
    assert not common.fits_broadcast(few.select("t").union(few.select("t")), 16) and not common.fits_broadcast(few.select("a").union(few.select("a")), 16)


@pytest.mark.parametrize("good, bad, n", [(4000, 92_000, 1000), (40, 3, 20), (5, 5, 10), (3, 100, 0)])
def test_counts_beyond_the_bound_of_the_library(monkeypatch, good, bad, n):
    """The own draw has the distribution of the library's, and works where that one ends."""
    rng, draws = np.random.default_rng(3), 20_000
    want = rng.hypergeometric(good, bad, n, draws)
    monkeypatch.setattr(sharding, "LIBRARY_BOUND", 0)
    got = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(draws)])
    values = np.union1d(want, got)
    far = np.abs(np.array([(got <= v).mean() - (want <= v).mean() for v in values])).max()
    assert far < 0.025 and got.min() >= max(0, n - bad) and got.max() <= min(n, good)


def test_a_hundred_billion_rows():
    drawn = sharding.matrix([10 ** 11 // 40] * 39 + [10 ** 11 - 39 * (10 ** 11 // 40) + 7], 24)
    assert drawn.sum() == 10 ** 11 + 7 and set(np.diff(np.sort(drawn.sum(0)))) <= {0, 1} and drawn.min() > 0
    # Counts of a part scatter around an even share as the law says.
    share = 10 ** 11 // 40 / 24
    assert 0.5 < np.std(drawn[:20]) / np.sqrt(share * 23 / 24) < 1.5


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(docs, labels, benchmark, name):
    rows = operators(labels, benchmark)[name](docs).collect()
    if name != "mixed":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 2, 3, 4, 4, 5]
    own = {r["doc_id"]: r for r in rows}
    if name == "near":
        assert own[1]["fp"] == own[2]["fp"] == 0 and own[2]["component_id"] == 1 and own[4]["in_component"] == 2
    if name == "leaks":
        assert own[4]["n_hit"] == 4 and own[4]["item_ids"] == ["1"] and own[3]["item_ids"] == [""] and own[1]["n_words"] == 0
        assert own[3]["n_hit"] == 40_000
    if name == "tokens":
        assert own[1]["n_tokens"] == 1 and min(r["start"] for r in rows) == 0
    if name == "pii":
        assert [s["kind"] for s in own[5]["base"]] == ["email", "phone"]
    if name == "shards":
        assert set(docs.columns) == set(rows[0].asDict()) and len({(r["shard"], r["slot"]) for r in rows}) == 8
    if name == "fertility":
        assert own[1]["base_failed"] and own[3]["n_words"] == 80_000


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, benchmark, name):
    assert operators(labels, benchmark)[name](docs.limit(0)).count() == 0


def test_lines_that_repeat_over_documents(spark):
    passage = "\n".join(f"line {k} of a passage" for k in range(12))
    rows = [(k, f"start {k}\n{passage}\nend {k}") for k in range(5)]
    got = {r["doc_id"]: r for r in line_chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed_lines"] == 0 and got[0]["kept_text"] == rows[0][1]
    assert all(got[k]["n_removed_lines"] >= 8 and f"end {k}" in got[k]["kept_text"] for k in range(1, 5))


def test_chunks_find_short_passages(spark):
    """Passages of 1 to 4 lines and blocks of one line between other lines: most go whole, and nothing else goes."""
    rng = np.random.default_rng(11)

    def line(n):
        return " ".join(f"w{rng.integers(10 ** 6)}" for _ in range(n))
    passages = ["\n".join(line(60 // n + 1) for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(50)]
    passages += ["\n".join([line(14)] * 6) for _ in range(50)]
    parts = [[line(9), p, line(9)] for p in passages * 2]
    rows = list(enumerate("\n".join(p) for p in parts))
    got = {r["doc_id"]: r for r in line_chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(passages)
    assert all(got[k]["kept_text"] == rows[k][1] for k in range(n))
    whole = [got[n + k]["kept_text"] == f"{parts[n + k][0]}\n{parts[n + k][2]}" for k in range(n)]
    assert all(parts[k][i] in got[k]["kept_text"] for k in range(2 * n) for i in (0, 2))
    share = [np.mean(whole[k:k + 50]) for k in range(0, n, 50)]
    assert share[0] == 1 and share[1] >= 0.5 and share[2] >= 0.75 and share[3] >= 0.85 and share[4] >= 0.6, share


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert len({got[k] for k in range(61)}) == 1 and got[100] == got[101] != got[0] and len(got) == 63


def test_buckets_that_are_split_lose_no_link(spark, monkeypatch):
    """One dense ball of fingerprints and single ones: components equal those of all pairs."""
    rng = np.random.default_rng(5)
    ball = np.uint64(1234567890123456789) ^ (np.uint64(1) << rng.integers(0, 64, (700, 6), dtype=np.uint64)).sum(1).astype(np.uint64)
    prints = np.unique(np.concatenate([ball, rng.integers(0, 2**63, 300, dtype=np.uint64)])).view(np.int64)
    monkeypatch.setattr(simhash, "BUCKET", 40)
    near = np.bitwise_count(prints.view(np.uint64)[:, None] ^ prints.view(np.uint64)) <= 3
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    found = simhash.links(spark.createDataFrame([(int(p),) for p in prints], "fp long"))
    root = {r["node"]: r["root"] for r in components.components(found).collect()}
    got = [root.get(int(p), int(p)) for p in prints]
    assert len(set(zip(got, label, strict=True))) == len(set(got)) == len(set(label))


def test_matrix_is_exact():
    drawn = sharding.matrix([10, 0, 993, 7], 24)
    assert drawn.sum(1).tolist() == [10, 0, 993, 7] and set(drawn.sum(0).tolist()) <= {42, 43}


def test_value_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    assert (token_files.unpack(*token_files.pack(values), len(values)) == values).all()
    assert len(token_files.unpack(*token_files.pack(values[:0]), 0)) == 0


def test_chain_marginals_equal_all_paths():
    from itertools import product
    rng = np.random.default_rng(1)
    sizes, trans = np.array([3, 0, 5, 1]), rng.normal(size=(2, 2))
    e = rng.normal(size=9)
    odds, pairs = toxicity.Chains(sizes).marginals(e, trans, with_pairs=True)
    want, total, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        paths = list(product((0, 1), repeat=int(n)))
        w = np.array([np.exp(sum(e[at + k] * s for k, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        for k in range(n):
            one = sum(x for x, p in zip(w, paths) if p[k])
            want.append(np.log(one / (1 - one)))
        for x, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                total[a, b] += x
        at += n
    assert np.allclose(odds, want) and np.allclose(pairs, total)


def test_gibberish_is_outside_the_bands(spark):
    """Planted texts without words of the language, long and short, go; texts of the language stay, short ones too."""
    rng = np.random.default_rng(3)
    words = "the house of a good friend was near water and many people came there with children every summer day".split()
    good = [" ".join(rng.choice(words, 200)) for _ in range(40)] + [" ".join(words[:14])]
    bad = [" ".join("".join(rng.choice(list("qxzjkvw"), 6)) for _ in range(n)) for n in (200, 12)]
    rows = [(k, t, "en") for k, t in enumerate(good + bad)]
    found = fertility.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [k for k, r in sorted(got.items()) if not r["kept"]] == [41, 42]


def slow_passages(rows):
    """Numbers of removed lines per (id, text), from all pairs of equal runs of lines that do not overlap."""
    lines = [(d, t, i, x, len(x.split())) for d, t in dict.fromkeys(rows) for i, x in enumerate(t.split("\n")) if x.split()]
    gone = set()
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            n = words = 0
            while (b + n < len(lines) and lines[a + n][:2] == lines[a][:2] and lines[b + n][:2] == lines[b][:2]
                   and lines[a + n][3] == lines[b + n][3] and a + n < b):
                words += lines[b + n][4]
                n += 1
            if words > 50:
                gone |= {(*lines[b][:2], i) for i in range(lines[b][2], lines[b + n - 1][2] + 1)}
    return gone


def test_passages_of_few_lines(spark):
    """Passages of 1 to 4 lines, blocks of one repeated line, and random mixes of lines equal those of all pairs."""
    rng = np.random.default_rng(9)
    def line(n):
        return " ".join(f"w{rng.integers(1000)}" for _ in range(n))
    passages = ["\n".join(line(60 // n + 1) for _ in range(n)) for n in (1, 2, 3, 4)] + ["\n".join([line(20)] * 6)]
    pool = [line(int(n)) for n in rng.integers(1, 40, 12)] + ["", " "]
    rows = [(k, "\n".join([line(5), p, line(5)])) for k, p in enumerate(passages * 3)]
    rows += [(20 + k, "\n".join(rng.choice(pool, 12))) for k in range(25)] + [(50, ""), (51, "\n \n")]
    found = line_chunks.without_passages(spark.createDataFrame(rows + rows[-3:], "doc_id long, text string")).collect()
    gone, got = slow_passages(rows), {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + 3
    for d, t in rows:
        kept = [x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone]
        assert got[d]["kept_text"] == "\n".join(kept) and got[d]["n_removed_lines"] == t.count("\n") + 1 - len(kept)
    assert all(got[k]["n_removed_lines"] == rows[k][1].count("\n") - 1 for k in range(5, 15))


def test_passages_of_odd_rows(docs):
    found = line_chunks.without_passages(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == [0, 0, 1, 2, 3, 4, 4, 5] and all(r["n_removed_lines"] == 0 for r in found)
    assert line_chunks.without_passages(docs.limit(0)).count() == 0


def test_blocks_of_one_repeated_line(spark):
    """A block of equal lines that repeats over documents goes."""
    block = "\n".join(["this very same line of nine words comes again"] * 8)
    rows = spark.createDataFrame([(k, f"start {k}\n{block}\nend {k}") for k in range(4)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_chunks.without_passages(rows).collect()}
    assert got[0]["n_removed_lines"] == 0
    assert all(got[k]["kept_text"] == f"start {k}\nend {k}" and got[k]["n_removed_lines"] == 8 for k in (1, 2, 3))


def test_tokens_have_their_places():
    """Lower-casing makes two characters of a capital I with dot; spans stay on their tokens."""
    text = "\u0130yi \u0130\u0130 Bad WORD end"
    found = toxicity.tokens(text)
    spans = toxicity._spans(text, np.zeros(len(found)))
    assert [text[s["start"]:s["end"]].lower() for s in spans] == found


def test_token_files_of_long_texts(spark, tmp_path, monkeypatch):
    """Few long documents are dealt over more files than few short ones."""
    monkeypatch.setattr(token_files, "TOKENS_PER_FILE", 100)
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(k, f"{k} " + "a word or two " * 30) for k in range(60)], "doc_id long, text string")
    token_files.write(docs, str(tmp_path / "files"), public.path("byte_bpe_50k.json"))
    frames = spark.read.parquet(str(tmp_path / "files/frames"))
    files = frames.groupBy("file_no").agg(F.sum("tokens").alias("n")).collect()
    assert len(files) > 30 and max(r["n"] for r in files) < 1000
    back = token_files.read(spark, str(tmp_path / "files")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in back] == list(range(60))
    assert [r["start"] for r in back] == [sum(r["n_tokens"] for r in back[:k]) for k in range(60)]
