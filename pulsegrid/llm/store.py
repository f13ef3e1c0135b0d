"""Shared storage, packed document blocks, and the block <-> bucket exchange.

A *block* is one row that holds a few megabytes of documents, compressed.  Blocks are
written once to the shared folder, so their identity survives lost executors; operators
that need corpus-wide statistics send packed keys from blocks to ranges of hashes (buckets),
reduce a bucket in one bounded task, and send the answers back by block.

A block sends at most one row to a bucket, and none without keys: the rows are fewer than the
blocks times the buckets and fewer than the keys.  Buckets grow in number with the corpus, so
that each fits a task's memory; tasks are at most MOST_PARTS and take their buckets in turn.
"""

from __future__ import annotations

import atexit
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block, and of text for which one bucket is opened; most shuffle partitions.
BLOCK_BYTES, BUCKET_BYTES, MOST_PARTS = 8 << 20, 24 << 20, 20_000
#: Documents at which a block ends; it has fewer than twice as many.
BLOCK_ROWS = 1 << 17
#: Settings while a table is written: shuffle files are removed when an execution ends, and a batch of
#: rows for Python is not much larger than this.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_BLOCK = "block long, n long, bytes long, ids binary, lengths binary, data binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a new local one if Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        atexit.register(shutil.rmtree, found[7:], True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/pulsegrid/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here.

    Once they are written, nothing needs the shuffle files behind them, so Spark removes those.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._pulsegrid_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing will read it again."""
    remove(df.sparkSession, getattr(df, "_pulsegrid_path", None))


def remove(spark: SparkSession, path: str | None) -> None:
    """Delete a folder of the shared storage, if there is one."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_pools: list[pa.MemoryPool] = []


def lean() -> None:
    """Make this Python worker give memory back to the system, at the end of a task.

    Workers are kept between stages; what their allocators held would add up in an executor.
    """
    import ctypes
    import ctypes.util

    if pa.default_memory_pool().backend_name != "system":  # others keep what was freed to themselves
        _pools.append(pa.default_memory_pool())
        pa.set_memory_pool(pa.system_memory_pool())
    for pool in _pools:
        pool.release_unused()
    try:
        c = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
        # fixed values: M_ARENA_MAX, M_MMAP_THRESHOLD and M_TRIM_THRESHOLD; what a block frees, the next one finds again
        c.mallopt(-8, 1)
        c.mallopt(-3, 32 << 20)
        c.mallopt(-1, 1 << 29)
        c.malloc_trim(0)  # at a task's end all of it goes
    except (OSError, AttributeError):  # another C library
        pass


class Block:
    """Documents of one block: ids (int64), a null mask of ids, and the text buffer."""

    def __init__(self, row: dict):
        self.block = row["block"]
        ids = np.frombuffer(row["ids"], np.int64)
        n = len(ids) // 2
        self.ids, self.null = ids[:n], ids[n:] != 0
        self.at = np.r_[0, np.cumsum(np.frombuffer(row["lengths"], np.int64))].astype(np.int64)
        self.other = row.get("other")
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(self.at[-1]))), np.uint8)

    def words(self, lower: bool = False):
        """The words of the whole texts."""
        from .text import Words

        return Words(self.raw, self.at, lower)

    def column(self, i: int) -> list:
        """Values of the i-th column of a table packed with whole_rows (neither id nor text)."""
        other = pa.ipc.open_stream(self.other).read_all().combine_chunks()["other"]
        return [v for c in other.chunks for v in c.field(f"c{i}").to_pylist()]

    def restored(self, names: list[str], id_col: str, text_col: str, rows: np.ndarray, texts: list | None = None) -> pa.RecordBatch:
        """Whole rows of the documents, in the given order of columns; texts replace their texts."""
        other = pa.ipc.open_stream(self.other).read_all().combine_chunks()
        other = other.column(0).chunk(0) if other.num_rows else pa.array([], other.schema.field(0).type)
        other = other.take(pa.array(rows))
        at = pa.array(rows)
        none = other.field("_no_text").to_numpy(zero_copy_only=False)
        if texts is None:
            raw = self.raw.tobytes()
            texts = [raw[self.at[i] : self.at[i + 1]].decode() for i in rows.tolist()]
        columns = {id_col: pa.array(self.ids, mask=self.null).take(at), text_col: pa.array([None if x and not t else t for x, t in zip(none, texts, strict=True)], pa.string())}
        return pa.RecordBatch.from_arrays([columns[n] if n in columns else other.field(f"c{i}") for i, n in enumerate(names)], names=names)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, name: str = "blocks", whole_rows: bool = False) -> DataFrame:
    """Pack (id, text) rows into a written table of blocks. Null ids are marked, null texts are empty.

    With whole_rows the block also holds the other columns, for Block.restored().
    """

    def pack(batches):
        from pyspark import TaskContext

        from .text import buffers

        at = TaskContext.get()
        number, ids, lengths, data, size, others = 0, [], [], [], 0, []

        def out():
            nonlocal number, ids, lengths, data, size, others
            i, n = np.ma.concatenate(ids), np.concatenate(lengths)
            row = [(at.partitionId() << 32) + number, len(n), size, np.concatenate([i.filled(0), np.ma.getmaskarray(i).astype(np.int64)]).astype(np.int64).tobytes(), n.tobytes(), zstandard.ZstdCompressor(level=1).compress(np.concatenate(data).tobytes())]
            if whole_rows:
                column = pa.concat_arrays(others)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("other", column.type)])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([column], names=["other"]))
                row.append(sink.getvalue().to_pybytes())
            number, ids, lengths, data, size, others = number + 1, [], [], [], 0, []
            return to_batch([tuple(row)], schema)

        for batch in batches:
            col = batch.column(0)
            ids_all = np.ma.array(col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), mask=col.is_null().to_numpy(zero_copy_only=False))
            raw, pos = buffers(batch.column(1))
            a = 0
            while a < batch.num_rows:
                b = min(a + BLOCK_ROWS, max(a + 1, int(np.searchsorted(pos, pos[a] + max(1, block_bytes - size), "right")) - 1))
                ids.append(np.ma.array(ids_all[a:b]))
                lengths.append(np.diff(pos[a : b + 1]))
                data.append(raw[pos[a] : pos[b]])
                size += int(pos[b] - pos[a])
                if whole_rows:
                    others.append(batch.column(2).slice(a, b - a))
                a = b
                if size >= block_bytes or sum(map(len, lengths)) >= BLOCK_ROWS:
                    ids = [np.ma.concatenate(ids)]
                    yield out()
            if ids:
                # copied, as a slice would hold its whole batch
                ids, lengths, data = [np.ma.concatenate(ids)], [np.concatenate(lengths)], [np.concatenate(data).copy()]
        if ids:
            ids = [np.ma.concatenate(ids)]
            yield out()

    picked = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    schema = _BLOCK
    if whole_rows:
        schema += ", other binary"
        others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)]
        picked.append(F.struct(F.col(text_col).isNull().alias("_no_text"), *others).alias("other"))
    return written(docs.select(*picked).mapInArrow(pack, schema), name)


def corpus_size(table: DataFrame) -> tuple[int, int]:
    """Documents and bytes of text in a table of blocks."""
    n, size = table.agg(F.sum("n"), F.sum("bytes")).first()
    return int(n or 0), int(size or 0)


def bucket_count(text_bytes: int) -> int:
    """Buckets for so much text, so that a bucket's keys stay within one task's memory."""
    return int(max(8, -(-text_bytes // BUCKET_BYTES)))


def shuffled(spark: SparkSession, text_bytes: int) -> int:
    """Shuffle partitions for packed rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, bucket_count(text_bytes)))


def cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending uint64 keys: the buckets (equal ranges of hashes) that have any, and where each one's begin and end."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at].astype(np.int64), np.r_[at, len(keys)].astype(np.int64)


def per_block(table: DataFrame, emit: Callable[[Block], Iterator[tuple]], schema: str, of: Callable = Block) -> DataFrame:
    """emit(of(row)) yields rows of the schema for each row of a table of blocks."""

    def run(batches):
        for row in rows(batches):
            for out in chunks(emit(of(row)), 512):
                yield to_batch(out, schema)
        lean()
        yield to_batch([], schema)

    return table.mapInArrow(run, schema)


def chunks(items, n: int):
    """Lists of up to n items, cut early when their bytes pass 8 MB."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += sum(len(v) for v in x if isinstance(v, bytes | bytearray))
        if len(held) >= n or size > 8 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "float": pa.float32()}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(", "))])


def to_batch(items: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows (tuples) as one Arrow batch."""
    s = arrow_schema(schema)
    cols = list(zip(*items, strict=True)) if items else [[] for _ in s]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, s, strict=True)], schema=s)


def columns_batch(arrays: list, schema: str) -> pa.RecordBatch:
    """Whole columns as one Arrow batch."""
    s = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, s, strict=True)], schema=s)


def grouped(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with an equal first column, from sorted batches: key, the other columns."""
    key, members = None, []
    for row in rows(batches):
        k, *rest = row.values()
        if k != key and members:
            yield key, members
            members = []
        key = k
        members.append(tuple(rest))
    if members:
        yield key, members


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays in one byte string."""
    out = []
    for a in arrays:
        code = a.dtype.str.encode().ljust(4)
        out += [struct.pack("<4sq", code, a.size), a.tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The inverse of pack."""
    out, i = [], 0
    while i < len(data):
        code, n = struct.unpack_from("<4sq", data, i)
        kind = np.dtype(code.decode().strip())
        out.append(np.frombuffer(data, kind, n, i + 12))
        i += 12 + n * kind.itemsize
    return out


def settle(fs, own: str, final: str) -> None:
    """Give a finished file its final name; where another attempt was first, its equal file stays."""
    from pyarrow import fs as pafs

    try:
        fs.move(own, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(own)


def ask(table: DataFrame, emit, reduce, text_bytes: int, name: str, of: Callable = Block) -> tuple[str, tuple[int, int]]:
    """Send packed keys from blocks to buckets and keep the answers, in a shared file for each block.

    emit(of(row)) yields (bucket, payload); reduce(bucket, [(block, payload)]) yields
    (block, reply).  Later passes over the blocks read only their own file (answers_of), so
    texts aren't shuffled.
    A file is written under an attempt's own name and then moved, so any attempt may win.
    Answers to block None are pairs of numbers; their sums over all buckets come back.
    """
    from .sequences import filesystem

    spark = table.sparkSession
    parts, path = shuffled(spark, text_bytes), fresh(spark, name)
    sent = per_block(table, lambda b: ((int(k), int(b.block), p) for k, p in emit(b)), "bucket int, block long, payload binary", of)

    def run(batches):
        for key, members in grouped(batches):
            # what is for no block is dealt out by the bucket's number
            for out in chunks(((-1 - int(key) if b is None else int(b), int(key), r) for b, r in reduce(key, members)), 512):
                yield to_batch(out, "block long, bucket int, reply binary")
        lean()
        yield to_batch([], "block long, bucket int, reply binary")

    def keep(batches):
        from pyspark import TaskContext

        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        for block, members in grouped(batches):
            if block < 0:
                yield to_batch([struct.unpack("<qq", r) for _, r in members], "a long, b long")
                continue
            own = f"{base}/.{TaskContext.get().taskAttemptId()}-{block}"
            with fs.open_output_stream(own, compression="zstd") as f:
                for bucket, r in members:
                    f.write(struct.pack("<iq", bucket, len(r)) + r)
            settle(fs, own, f"{base}/{block}")
        lean()
        yield to_batch([], "a long, b long")

    answers = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket int, reply binary")
    kept = written(answers.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(keep, "a long, b long"), name)
    sums = kept.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    drop(kept)
    return path, (int(sums[0]), int(sums[1]))


def answers_of(path: str, block: int) -> dict[int, bytes]:
    """A block's answers from ask(); none if nothing was asked."""
    from pyarrow import fs as pafs

    from .sequences import filesystem

    fs, base = filesystem(path)
    if fs.get_file_info(f"{base}/{block}").type == pafs.FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{base}/{block}", compression="zstd") as f:
        data = f.read()
    out, i = {}, 0
    while i < len(data):
        bucket, n = struct.unpack_from("<iq", data, i)
        out[bucket] = data[i + 12 : i + 12 + n]
        i += 12 + n
    return out


def restored_schema(docs: DataFrame, id_col: str):
    """The schema that Block.restored() gives: that of docs, with a long id."""
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, T.LongType() if f.name == id_col else f.dataType) for f in docs.schema])


def deliver(df: DataFrame, name: str) -> str:
    """Write rows (block, ...) to shared files, one for each block, for delivered()."""
    from .sequences import filesystem

    spark = df.sparkSession
    path, parts = fresh(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get().taskAttemptId()
        open_block, sink, writer, own = None, None, None, ""

        def close():
            if writer:
                writer.close()
                sink.close()
                settle(fs, own, f"{base}/{open_block}")

        for batch in batches:
            block = batch.column("block").to_numpy()
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if block[a] != open_block:
                    close()
                    open_block, own = int(block[a]), f"{base}/.{task}-{int(block[a])}"
                    sink = fs.open_output_stream(own)
                    writer = pa.ipc.new_stream(sink, batch.schema)
                writer.write_batch(batch.slice(a, b - a))
        close()
        lean()
        yield to_batch([], "done int")

    drop(written(df.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "done int"), name))
    return path


def delivered(path: str, block: int) -> pa.Table | None:
    """The rows that deliver() wrote for a block."""
    from pyarrow import fs as pafs

    from .sequences import filesystem

    fs, base = filesystem(path)
    if fs.get_file_info(f"{base}/{block}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{base}/{block}") as f:
        return pa.ipc.open_stream(f).read_all()
