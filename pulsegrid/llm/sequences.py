"""Token ids in Arrow stream files of fixed-size-list batches (op9).

A file is an Arrow IPC stream of record batches with the columns ``ids``, ``mask`` (a real
token) and ``last`` (the last token of a document): lists of exactly L entries, so every
sequence lies at a fixed place in its batch's buffers and is read without copying from a
memory map; mask and last take a bit a token.  Only the last sequence of a file is padded.  Ids are stored in the
smallest unsigned type that holds the vocabulary.  Documents lie end to end in ascending order
of ids; files are numbered in that order, and an index stream beside each file has the
documents' ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, tokens
from .text import buffers

LENGTH, BATCH_ROWS, END_ID, FILE_BYTES = 2048, 256, 2, 64 << 20


def filesystem(uri: str):
    """The file system and path of a URI or plain path, as executors see it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Writes one stream file and its index; memory is one batch."""

    def __init__(self, sink, index_sink, dtype, length: int = LENGTH, rows: int = BATCH_ROWS):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))], metadata={"length": str(length), "rows": str(rows)})
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_stream(index_sink, self.index_schema)
        self.ids, self.last, self.tokens, self.docs = [], [], 0, 0
        self.held = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents' ids end to end (each with its end id) and how many each has."""
        last = np.zeros(len(ids), bool)
        last[np.cumsum(counts) - 1] = True
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64())], schema=self.index_schema))
        self.ids.append(ids.astype(self.dtype))
        self.last.append(last)
        self.tokens, self.docs, self.held = self.tokens + len(ids), self.docs + len(counts), self.held + len(ids)
        self._flush(False)

    def _flush(self, end: bool) -> None:
        room = self.length * self.rows
        if self.held < room and not end or not self.held:
            return
        ids, last = np.concatenate(self.ids), np.concatenate(self.last)
        mask = np.ones(len(ids), bool)
        n = len(ids) if end else len(ids) // room * room
        if end and n % self.length:
            pad = self.length - n % self.length
            ids, mask, last = np.r_[ids, np.zeros(pad, self.dtype)], np.r_[mask, np.zeros(pad, bool)], np.r_[last, np.zeros(pad, bool)]
            n += pad
        for a in range(0, n, room):
            part = slice(a, min(n, a + room))
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), type=f.type) for x, f in zip((ids, mask, last), self.schema, strict=True)]
            self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.ids, self.last = [ids[n:]], [last[n:]]
        self.held = len(self.ids[0])

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.index.close()


class SequenceFile:
    """Random access to the sequences of one file, zero-copy from a memory map or buffer."""

    def __init__(self, source):
        self.buffer = pa.memory_map(source).read_buffer() if isinstance(source, str) else pa.py_buffer(source)
        self.batches = list(pa.ipc.open_stream(self.buffer))
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i: views of the file's bytes."""
        batch, row = self.batches[i // self.rows], i % self.rows
        ids, mask = batch.column("ids"), batch.column("mask")
        n = ids.type.list_size
        return ids.values.slice(row * n, n).to_numpy(zero_copy_only=True), mask.values.slice(row * n, n)


def write_sequences(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write all documents; the written manifest has file, first_doc, docs, tokens.

    A file is written under an attempt's own name and then moved to its final one, so a lost
    executor or a second attempt leaves nothing half-written.
    """
    spark = docs.sparkSession
    tokens.check_split(tokenizer)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        number, writer, sinks, made = 0, None, [], []

        def close():
            nonlocal writer, sinks, number
            writer.close()
            for s in sinks:
                s.close()
            name = f"part-{at.partitionId():06d}-{number:06d}"
            for kind in ("arrows", "index"):
                store.settle(fs, f"{base}/.{tag}.{kind}", f"{base}/{name}.{kind}")
            made.append((name, at.partitionId(), number, writer.docs, writer.tokens))
            writer, sinks, number = None, [], number + 1

        tag = ""
        for batch in batches:
            raw, pos = buffers(batch.column(1))
            for a, b in tokens.slices(pos):
                coder = tokens.encoder(tokenizer)
                ids, begin = coder.encode(raw[pos[a] : pos[b]], pos[a : b + 1] - pos[a], end_id)
                if writer is None:
                    tag = f"{at.partitionId()}-{number}-{at.taskAttemptId()}"
                    sinks = [fs.open_output_stream(f"{base}/.{tag}.{x}") for x in ("arrows", "index")]
                    small = np.uint16 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
                    writer = SequenceWriter(*sinks, small, length)
                writer.add(batch.column(0).slice(a, b - a), ids, np.diff(begin))
                if writer.tokens * writer.dtype.itemsize >= FILE_BYTES:
                    close()
        if writer:
            close()
        store.lean()
        yield store.to_batch(made, "file string, part int, number int, docs long, tokens long")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return store.written(ordered.mapInArrow(run, "file string, part int, number int, docs long, tokens long"), "manifest")


def read_sequences(spark: SparkSession, manifest: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    One task reads a file, a batch at a time.  Starts of files are running sums of the manifest,
    one row for each file.
    """
    from pyspark.sql import Window as W

    before = F.sum("tokens").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.withColumn("begin", F.coalesce(before, F.lit(0))).select("file", "begin")
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"

    def run(batches):
        for row in store.rows(batches):
            fs, base = filesystem(path)
            with fs.open_input_stream(f"{base}/{row['file']}.index") as f:
                index = pa.ipc.open_stream(f).read_all()
            begin = row["begin"]
            crc, count, crcs, counts = 0, 0, [], []
            with fs.open_input_stream(f"{base}/{row['file']}.arrows") as f:
                for batch in pa.ipc.open_stream(f):
                    real, last = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("mask", "last"))
                    ids = batch.column("ids").flatten().to_numpy()[real].astype("<u4")
                    data, a = ids.tobytes(), 0
                    for b in (np.flatnonzero(last[real]) + 1).tolist():
                        crcs.append(zlib.crc32(data[a * 4 : b * 4], crc))
                        counts.append(count + b - a)
                        a, crc, count = b, 0, 0
                    if a < len(ids):
                        crc, count = zlib.crc32(data[a * 4 :], crc), count + len(ids) - a
            counts = np.array(counts, np.int64)
            if len(counts) != index.num_rows or (counts != index["n_tokens"].to_numpy()).any():
                raise ValueError(f"{row['file']}: the index does not match the sequences")
            yield store.columns_batch([index["doc_id"].combine_chunks(), begin + np.cumsum(counts) - counts, counts, np.array(crcs, np.int64)], schema)

    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and read every document back.

    Null and empty texts are one end id.  Null ids come first; rows that share an id are
    ordered by text.  Extra columns are ignored; an empty table gives an empty result.
    """
    path = store.fresh(docs.sparkSession, "sequences")
    return read_sequences(docs.sparkSession, write_sequences(docs, tokenizer, path, id_col, text_col, length, end_id), path, id_col)
