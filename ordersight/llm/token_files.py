"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the whole corpus, so the 256 most frequent take one byte. Four values share a
control byte with two bits each (data bytes less one); control and data bytes lie apart. Decoding looks up the
four lengths of a control byte in a table and gathers the data bytes with numpy.

A frame holds consecutive documents: b"SVB1", then as little-endian uint32 the numbers of documents and values,
the tokens of each document, the control bytes and the data bytes. Frames are rows of Parquet files (file_no,
frame_no, before, tokens, doc_ids, frame); `before` counts the tokens of the frames in front within the file. So writes
are atomic, survive lost executors and go to any store that Spark can reach. The ranking is a table beside them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordersight.llm.bpe import PieceEncoder
from ordersight.llm.common import durable, sized
from ordersight.session import scratch_path

END = 2
MAGIC = b"SVB1"
FRAME_TOKENS = 1 << 18
DOCS_AT_ONCE = 500
DOCS_PER_FILE = 50_000
#: A task holds about the ids of one file, however long the documents are.
TOKENS_PER_FILE = 1 << 23

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.int64)
    codes[:len(values)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)
    kept = np.arange(4) < sizes[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(sizes > k)
        out[at] |= padded[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def frame_of(sizes: list[int], values: np.ndarray) -> bytes:
    control, data = pack(values)
    return b"".join([MAGIC, struct.pack("<II", len(sizes), len(values)), np.array(sizes, "<u4").tobytes(), control, data])


def read_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per document and all values."""
    if frame[:4] != MAGIC:
        raise ValueError("not a token frame")
    docs, n = struct.unpack_from("<II", frame, 4)
    at = 12 + 4 * docs
    ctrl = -(-n // 4)
    return np.frombuffer(frame, "<u4", docs, 12).astype(np.int64), unpack(frame[at:at + ctrl], frame[at + ctrl:], n)


def width(path: str) -> str:
    """The narrowest unsigned type that holds all ids of a vocabulary."""
    from tokenizers import Tokenizer
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def _encoded(path: str, end: int, kind: str):
    """Rows (doc_id, ids, null), and at the end of a task one row (null, null, its counts of all ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        total = np.zeros(0, np.int64)
        names = ["doc_id", "ids", "counts"]
        for whole in batches:
            for lo in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(lo, DOCS_AT_ONCE)
                ids, sizes = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end)
                found = np.bincount(ids, minlength=len(total))
                found[:len(total)] += total
                total = found
                ends = ends + np.arange(1, len(ends) + 1)
                rows = [x.tobytes() for x in np.split(ids.astype(kind), ends[:-1])]
                yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], names)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            n = np.frombuffer(counts, np.int64)
            met = np.flatnonzero(n)
            yield pa.record_batch([pa.array(met), pa.array(n[met])], ["id", "n"])


def _framed(rank: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, frame_no, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values = np.concatenate(parts)
            return pa.record_batch([
                pa.array([file_no], pa.int32()), pa.array([frame_no], pa.int32()), pa.array([before], pa.int64()),
                pa.array([len(values)], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                pa.array([frame_of([len(p) for p in parts], values)], pa.binary())],
                ["file_no", "frame_no", "before", "tokens", "doc_ids", "frame"])
        held = 0
        for batch in batches:
            for doc_id, ids in zip(*batch.columns, strict=True):
                docs.append(doc_id.as_py())
                parts.append(rank[np.frombuffer(ids.as_buffer(), kind)])
                held += len(parts[-1])
                if held >= FRAME_TOKENS:
                    yield flush()
                    frame_no, before, held, docs, parts = frame_no + 1, before + held, 0, [], []
        if docs:
            yield flush()
    return run


def _decoded(id_of_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, frame in zip(*batch.columns, strict=True):  # one frame at a time
                start, doc_ids = start.as_py(), doc_ids.as_py()
                sizes, values = read_frame(frame.as_py())
                ids = id_of_rank[values].astype("<u4")
                ends = np.cumsum(sizes)
                yield pa.record_batch([
                    pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes),
                    pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])
    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int = END) -> None:
    """Encode (doc_id, text) and write frames and ranking under `path`, in ascending doc_id order, nulls first.

    A null text is empty and has the end id alone. Rows with one id are ordered by their ids. The ranking has a
    row per id of the vocabulary at most, which bounds what the driver reads and the tasks are sent. Other
    columns are left out; an empty table gives no frames.
    """
    kind = width(tokenizer_path)
    encoded = durable(docs.select("doc_id", "text").mapInArrow(
        _encoded(tokenizer_path, end, kind), "doc_id long, ids binary, counts binary"))
    ids = encoded.where("counts IS NULL").select("doc_id", "ids")
    counts = encoded.where("counts IS NOT NULL").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranking = counts.orderBy(F.desc("n"), "id").collect()
    id_of_rank = np.array([r["id"] for r in ranking], np.int64)
    rank = np.zeros(int(id_of_rank.max(initial=0)) + 1, np.uint32)
    rank[id_of_rank] = np.arange(len(id_of_rank))
    spark = docs.sparkSession
    spark.createDataFrame([(k, int(i)) for k, i in enumerate(id_of_rank)], "rank long, id long").coalesce(1).write.parquet(
        f"{path}/ranking")
    files = max(12, -(-ids.count() // DOCS_PER_FILE), -(-sum(r["n"] for r in ranking) // TOKENS_PER_FILE))
    (ids.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(_framed(rank, kind), "file_no int, frame_no int, before long, tokens long, doc_ids array<long>, frame binary")
     .write.parquet(f"{path}/frames"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian uint32) of every document of the files."""
    ranking = spark.read.parquet(f"{path}/ranking").orderBy("rank").collect()
    id_of_rank = np.array([r["id"] for r in ranking], np.int64)
    frames = spark.read.schema("file_no int, frame_no int, before long, tokens long, doc_ids array<long>, frame binary").parquet(
        f"{path}/frames")
    # One row per file goes through the window.
    files = frames.groupBy("file_no").agg(F.sum("tokens").alias("tokens"))
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    first = sized(files.select("file_no", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("first")), 16)
    return (frames.join(first, "file_no").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "frame")
            .mapInArrow(_decoded(id_of_rank), "doc_id long, start long, n_tokens long, ids binary"))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path)
    return read(docs.sparkSession, path)
