"""WARC archives with a Zstandard dictionary of their own (op3).

An archive begins with one skippable frame that holds the dictionary, built from the records
that the archive itself holds; every record is then a frame of its own, compressed with that
dictionary, so any record can be read alone.  Repeated payloads become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .sequences import filesystem

#: Fixed value of the format: the magic number of the skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Bytes of records held for one archive, bytes of its dictionary, least payload that may be revisited.
ARCHIVE_BYTES, DICTIONARY_BYTES, LEAST_REVISIT = 16 << 20, 64 << 10, 100
_WARC = "WARC/1.1\r\n"


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (refers_to given) has no block."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    return (_WARC + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] + "\r\n" != _WARC:
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its header")
    return headers, rest[:n]


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from all records of an archive; raw content where there are too few to train on."""
    total = sum(map(len, records))
    size = min(size, max(256, total // 8))
    if len(records) >= 8 and total >= 1 << 14:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return b"".join(records)[:size] if total >= 8 else b"WARC/1.1"


def archive(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive: the skippable frame with the dictionary, then a frame for each record."""
    raw = dictionary(records)
    kind = zstandard.ZstdCompressionDict(raw)
    packer = zstandard.ZstdCompressor(level=level, dict_data=kind, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(packer.compress, records)])


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive, from a file-like object, a frame at a time."""
    head = stream.read(8)
    magic, n = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the dictionary's frame is missing")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(n)))
    held = b""
    while True:
        held = held or stream.read(1 << 20)
        if not held:
            return
        one, out = unpacker.decompressobj(), []
        while True:
            out.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
            if one.eof:
                break
            held = stream.read(1 << 20)
            if not held:
                raise ValueError("an archive ends inside a record")
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, block_bytes: int = store.BLOCK_BYTES) -> DataFrame:
    """Write a record for every row; returns the written manifest (file, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest id are
    responses and the others revisit it.  Payloads are packed once in blocks and never
    shuffled: only digests are, and a block finds what its rows revisit in a file of its own.
    Archives are written under an attempt's own name and then moved to their final one.
    """
    url = F.col(url_col) if url_col in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    table = store.blocks(rows, "id", "payload", block_bytes, "pages", whole_rows=True)

    def describe(block):
        raw = block.raw.tobytes()
        for i, (a, b) in enumerate(zip(block.at[:-1].tolist(), block.at[1:].tolist(), strict=True)):
            if b - a >= least and not block.null[i]:
                yield hashlib.sha256(raw[a:b]).digest(), int(block.ids[i]), int(block.block), i

    narrow = store.written(store.per_block(table, describe, "digest binary, id long, block long, place int"), "digests")
    # map-side sums first, so a popular payload is a few rows of its digest
    repeated = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    answers = store.deliver(narrow.join(repeated, "digest").where("id != first").select("block", "place", "first"), "revisits")

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get()
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        held, size, number = [], 0, 0

        def out():
            nonlocal held, size, number
            name = f"part-{at.partitionId():06d}-{number:05d}.warc.zst"
            data = archive(held)
            # by itself the file system would compress a name like this once more
            with fs.open_output_stream(f"{base}/.{at.taskAttemptId()}-{name}", compression=None) as f:
                f.write(data)
            store.settle(fs, f"{base}/.{at.taskAttemptId()}-{name}", f"{base}/{name}")
            row = (name, len(held), len(data))
            held, size, number = [], 0, number + 1
            return store.to_batch([row], "file string, records long, bytes long")

        for r in store.rows(batches):
            block = store.Block(r)
            found = store.delivered(answers, block.block)
            revisits = {} if found is None else dict(zip(found["place"].to_pylist(), found["first"].to_pylist(), strict=True))
            raw, urls = block.raw.tobytes(), block.column(1)
            for i, (a, b) in enumerate(zip(block.at[:-1].tolist(), block.at[1:].tolist(), strict=True)):
                payload = raw[a:b]
                held.append(record(None if block.null[i] else int(block.ids[i]), urls[i], payload, hashlib.sha256(payload).hexdigest(), revisits.get(i)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
        if held:
            yield out()
        store.lean()
        yield store.to_batch([], "file string, records long, bytes long")

    return store.written(table.mapInArrow(run, "file string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, manifest: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Every record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Responses' lengths and digests are taken from the block itself; one that does not match its
    header raises.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def number(x: str) -> int | None:
        x = x[len("<urn:page:") : -1]
        return None if x == "null" else int(x)

    def run(batches):
        fs, base = filesystem(path)
        for r in store.rows(batches):
            def items(name=r["file"]):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for data in read_archive(f):
                        h, block = parse(data)
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != n):
                            raise ValueError("a payload does not match its digest")
                        to = h.get("WARC-Refers-To")
                        yield (number(h["WARC-Record-ID"]), h["WARC-Target-URI"], n, digest, h["WARC-Type"], number(to) if to else None) + (block,) * with_payload

            for out in store.chunks(items(), 2000):
                yield store.to_batch(out, schema)

    return manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder and read every record back.

    Null payloads are empty.  Rows with a null id are responses and nothing refers to them;
    rows that share the smallest id of a payload are all responses.  Extra columns are ignored;
    an empty table gives an empty result.  A payload of any length is one part of one block and
    one record, so the longest must fit a task's memory.
    """
    path = store.fresh(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, write_archives(pages, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
