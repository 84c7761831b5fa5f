"""Token ids of documents as compressed files, in ascending order of document, and reading them back.

Writing encodes every text where it is read and sends only its ids (two bytes each, for vocabularies that allow it) to
the file that its document belongs to. The bounds between files are quantiles of the document ids, found beforehand
from that column alone, so texts are encoded once. Within a file documents are sorted and gathered into blocks of about
``BLOCK`` ids, which ``idcoder`` compresses; a block holds whole documents, so each can be read by itself, and a longer
document is a block of its own. Memory follows a block or the longest document.

The format: a folder of Parquet files with a row per block: ``part`` (files ascend by it), ``at`` (ids of the part
before the block), ``n_ids``, ``first_id`` and ``last_id`` (bounds of the document ids, by which readers skip files and
row groups), ``ids`` (the documents' ids in order), and ``block``, the bytes that ``idcoder`` describes, with checksums
of its own. Spark's writer commits the files, so a lost executor leaves no half file behind.

Document ids are whole numbers; documents without one come first. Rows that repeat an id are documents of their own,
next to each other; so many of them that they fill several files are dealt to these by a hash of their place in the
input. A null text counts as empty and has only the end id. Other columns are ignored. An empty table gives a folder
that reads as no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaline.llm import idcoder
from quotaline.llm import textbatch as tb
from quotaline.llm.packing import encoder
from quotaline.llm.shared import ship, tasks

#: Ids of a block, unless a single document has more.
BLOCK = 1 << 20
#: Documents of a file, about, and files at most.
FILE_ROWS, FILES = 100_000, 50_000
_FIRST = -(1 << 63)


def binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of numbers, bounded by ``at``, as byte strings."""
    bytes_at = at * flat.itemsize
    kind, offset = (pa.binary(), np.int32) if bytes_at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(bytes_at.astype(offset)), pa.py_buffer(np.ascontiguousarray(flat))])


def _bounds(ids: DataFrame) -> np.ndarray:
    """The ids at which files begin, but for the first: quantiles, as many as the rows ask for."""
    spark = ids.sparkSession
    n = ids.count()
    files = max(1, min(FILES, n, max(tasks(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_ROWS))))
    if files == 1:
        return np.zeros(0, np.int64)
    at = [k / files for k in range(1, files)]
    found = ids.agg(F.percentile_approx("id", at, F.lit(max(10_000, 20 * files))).alias("at")).first()["at"]
    return np.array(found, np.int64)


def _encode(path: str, end_id: int, vocab: int, bounds: np.ndarray):
    dtype = np.dtype("<u2" if vocab <= 1 << 16 else "<u4")

    def part(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The file of every row: by id, and where one id fills several files, by the hash of the row's place."""
        low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
        return low + ((place % np.uint64(1 << 20)).astype(np.int64) * (high - low + 1) >> 20)

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for texts in tb.slices(batch.column(2)):
                ids, at = e.encode(texts)
                flat = np.insert(ids, at[1:], end_id).astype(dtype)
                key, place = (batch.column(k).slice(texts.first, len(texts)) for k in (0, 1))
                of = part(key.to_numpy(), place.to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), key, place, binary(flat, at + np.arange(len(at)))], ["part", "id", "place", "ids"])

    return run


def _write(vocab: int, most: int):
    dtype = np.dtype("<u2" if vocab <= 1 << 16 else "<u4")
    names = ["part", "at", "n_ids", "first_id", "last_id", "ids", "block"]

    def flush(part: int, at: int, keys: list[np.ndarray], held: list[np.ndarray], lengths: list[np.ndarray]) -> pa.RecordBatch:
        key, ids = np.concatenate(keys), np.concatenate(held)
        data = idcoder.block(ids, np.concatenate(lengths), vocab)
        given = pa.array([key], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (at, len(ids), key[0], key[-1])), given, pa.array([data], pa.binary())], names)

    def run(batches):
        keys, held, lengths, waiting, at, part = [], [], [], 0, 0, 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            key = batch.column(1).to_numpy()
            column = batch.column(2)
            offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            flat = np.frombuffer(column.buffers()[2], dtype, count=(offsets[-1] - offsets[0]) // dtype.itemsize, offset=int(offsets[0])) if batch.num_rows and offsets[-1] > offsets[0] else np.zeros(0, dtype)
            bound = (offsets - offsets[0]) // dtype.itemsize
            k = 0
            while k < len(key):
                # the documents that the block still takes, one at least if it is empty
                end = max(int(np.searchsorted(bound, bound[k] + most - waiting, "right")) - 1, k + (waiting == 0))
                if end > k:
                    keys.append(key[k:end])
                    held.append(flat[bound[k] : bound[end]].copy())
                    lengths.append(np.diff(bound[k : end + 1]))
                    waiting += int(bound[end] - bound[k])
                if end < len(key) or waiting >= most:
                    yield flush(part, at, keys, held, lengths)
                    keys, held, lengths, waiting, at = [], [], [], 0, at + waiting
                k = end
        if waiting:
            yield flush(part, at, keys, held, lengths)

    return run


def write(documents: DataFrame, path: str, folder: str, end_id: int = 1, vocab: int = 49_408, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, encoded by the tokenizer file ``path`` with ``end_id`` after each, to a new folder."""
    ship(documents.sparkSession)
    key = F.coalesce(documents[id_col].cast("long"), F.lit(_FIRST))
    bounds = _bounds(documents.select(key.alias("id")))
    rows = documents.select(key.alias("id"), F.xxhash64(F.monotonically_increasing_id()).alias("place"), documents[text_col].alias("text"))
    rows = rows.mapInArrow(_encode(path, end_id, vocab, bounds), "part int, id long, place long, ids binary")
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("id", "place").select("part", "id", "ids")
    blocks = rows.mapInArrow(_write(vocab, block), "part int, at long, n_ids long, first_id long, last_id long, ids array<long>, block binary")
    blocks.write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``start``, ``n_tokens``, ``ids_crc32`` and (``with_ids``) ``ids`` of every document in a folder.

    ``first`` and ``last`` read only the blocks that may hold documents in that range. The driver gets two numbers a
    file, where each begins.
    """
    ship(spark)
    blocks = spark.read.parquet(folder)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.max(F.col("at") + F.col("n_ids")).alias("n")).collect())
    parts = np.array([p for p, _ in totals], np.int64)
    base = np.concatenate([[0], np.cumsum([n for _, n in totals])]).astype(np.int64)
    if first is not None:
        blocks = blocks.where(F.col("last_id") >= first)
    if last is not None:
        blocks = blocks.where(F.col("first_id") <= last)
    names = ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, at = (batch.column(k)[row].as_py() for k in (0, 1))
                ids, lengths = idcoder.texts(batch.column(3)[row].as_buffer().to_pybytes())
                bound = np.append(0, np.cumsum(lengths))
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                start = base[np.searchsorted(parts, part)] + at + bound[:-1]
                columns = [batch.column(2)[row].values, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    out = blocks.select("part", "at", "ids", "block").mapInArrow(run, schema)
    if first is not None:
        out = out.where(F.col("id") >= first)
    if last is not None:
        out = out.where(F.col("id") <= last)
    return out.withColumn("id", F.when(F.col("id") != _FIRST, F.col("id"))).withColumnRenamed("id", id_col)
