"""Media columns: content-addressed payloads in tar shards.

A text is padded to whole rows of 192 samples and stored as an 8-bit grey PNG
image, which is lossless.  Tasks append images to tar shards in shared storage
and return rows of (digest, shard, offset, length); the rows are the index.
Each payload is stored once.  Digests alone are shuffled to find those that
repeat; payloads whose digest does not repeat are written where they are read, and
only the rest, as compressed images, go through a shuffle that keeps one of each.
Metadata columns come from range reads of the 33 header bytes; payloads come from
range reads of whole members.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import HEAVY, bounded_batches, join_groups, maybe_in
from waygraph.plans.stages import materialise, shared_dir, table

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the IHDR chunk with its length, type and check sum.
HEADER = 33
INDEX = "digest string, shard string, offset long, length long"
#: A shard is closed once it is this large, and its task opens another.
SHARD_BYTES = 1 << 30
#: Payload bytes that a reading task is to get, at most about and at least.
READ_BYTES, READ_LEAST = 128 << 20, 2 << 20


def pad(text: bytes, width: int = WIDTH) -> bytes:
    """Append spaces up to a positive multiple of ``width``."""
    return text + b" " * ((-len(text)) % width if text else width)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey image, rows of ``width`` samples, each with filter type 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image written by to_png."""
    width, height, _ = png_header(data)
    raw, at = b"", HEADER
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IDAT":
            raw += data[at + 8 : at + 8 + n]
        at += n + 12
    rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(payload: bytes, width: int = WIDTH) -> str:
    """Mean, standard deviation and a 64-bit gradient hash of the image."""
    x = np.frombuffer(payload, np.uint8)
    rows = x.reshape(-1, width).astype(np.float64)
    columns = rows.mean(axis=0)
    bands = np.add.reduceat(columns, np.linspace(0, width, 66)[:-1].astype(int))
    bits = (bands[1:] > bands[:-1]).astype(int)
    return f"{width}x{len(rows)};mean={x.mean():.4f};std={x.std():.4f};hash={int(''.join(map(str, bits)), 2):016x}"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def store(media: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``(digest, media)`` into tar shards below ``folder``; the index rows.

    Each task writes shards of about ``shard_bytes`` at most under names of their
    own; a task that is run again writes others, and only the index says which
    shards hold.  Digests must be distinct.
    """

    def write(batches):
        shard, out, at = "", None, 0
        for b in batches:
            rows = []
            for digest, data in zip(b["digest"], b["media"], strict=True):
                if out is not None and at + len(data) > shard_bytes:
                    out.write(b"\0" * 1024)
                    out.close()
                    out = None
                if out is None:
                    shard, at = f"{folder}/{uuid.uuid4().hex}.tar", 0
                    system, path = _open(shard)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(data)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + data + b"\0" * (-len(data) % 512))
                rows.append((digest, shard, at + len(head), len(data)))
                at += len(head) + len(data) + (-len(data) % 512)
            yield pd.DataFrame(rows, columns=["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return materialise(media.select("digest", "media").mapInPandas(write, INDEX), "media-index")


def ranges(rows: pd.DataFrame, most: int | None = None):
    """Bytes of each row's range, at most the first ``most`` of them."""
    files = {}
    try:
        for shard, offset, length in zip(rows["shard"], rows["offset"], rows["length"], strict=True):
            if shard not in files:
                system, path = _open(shard)
                files[shard] = system.open_input_file(path)
            files[shard].seek(offset)
            yield files[shard].read(length if most is None else min(length, most))
    finally:
        for f in files.values():
            f.close()


def dealt_by_bytes(index: DataFrame) -> DataFrame:
    """The index dealt over as many tasks as the bytes of the members ask for, not those of the index.

    Tasks take ranges of (shard, offset), so members that lie together are read in order.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // READ_BYTES), min(4 * index.sparkSession.sparkContext.defaultParallelism, -(-total // READ_LEAST)), 1)
    return index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


def with_header(index: DataFrame) -> DataFrame:
    """The index with ``width, height, bit_depth``, from header-only range reads."""

    def read(batches):
        for b in batches:
            found = [png_header(x) for x in ranges(b, HEADER)]
            yield b.assign(width=[x[0] for x in found], height=[x[1] for x in found], bit_depth=[x[2] for x in found])

    return dealt_by_bytes(index).mapInPandas(read, INDEX + ", width int, height int, bit_depth int")


def with_payload_facts(index: DataFrame) -> DataFrame:
    """The index with sizes, digests and features of the payloads read back."""
    more = ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"

    def read(batches):
        for b in batches:
            rows = []
            for data in ranges(b):
                p = from_png(data)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(data).hexdigest(), feature(p)))
            facts = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])
            yield pd.concat([b.reset_index(drop=True), facts], axis=1)

    return dealt_by_bytes(index).mapInPandas(read, index._jdf.schema().toDDL() + more)


def _described(text: str) -> tuple[Column, Column, Column]:
    """(text, its bytes, digest of its padded payload)."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.octet_length(body)
    size = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int") * WIDTH
    return body, n.cast("long"), F.sha2(F.rpad(F.encode(body, "UTF-8"), size, F.lit(" ").cast("binary")), 256)


def _repeated(docs: DataFrame, text: str) -> DataFrame:
    """``digest, n`` of the payloads of several rows."""
    return materialise(docs.select(_described(text)[2].alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")


def store_texts(docs: DataFrame, folder: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), repeated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Store every text; return (rows: ``keep, n_bytes, digest``, index with header columns).

    The digest is SHA-256 of the padded payload, so texts that differ only in
    spaces at the end may share a payload; ``n_bytes`` stays with the row.  Null
    is empty.  Rows that repeat keep a row each and share a payload; an empty table
    gives two empty results.  A long text is one member, whatever its length.
    Other columns are not read.  ``repeated`` may give the digests of several rows.
    """
    bounded_batches(docs.sparkSession)
    body, n, digest = _described(text)
    rows = docs.select(*[F.col(c) for c in keep], n.alias("n_bytes"), digest.alias("digest"))

    def images(batches):
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "media": [to_png(pad(t.encode())) for t in b["body"]]})

    repeated = _repeated(docs, text) if repeated is None else repeated
    source = docs.select(digest.alias("digest"), body.alias("body"))
    source = maybe_in(source, repeated.select("digest"), "digest", "again")  # false only for digests that are there once
    once = source.filter("not again").select("digest", "body").mapInPandas(images, "digest string, media binary")
    copies = source.filter("again").select("digest", "body").mapInPandas(images, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))
    index = store(once, folder).unionByName(store(copies, folder))
    return rows, materialise(with_header(index), "media-headers")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents stored, read back and described."""
    docs = table(spark, sf_dir, "documents")
    repeated, total = _repeated(docs, "text"), docs.count()
    rows, index = store_texts(docs, shared_dir(spark, "media"), repeated=repeated)
    # the rows of a payload of many copies stay where they are; such payloads are at most HEAVY
    many = repeated.filter(F.col("n") * HEAVY > total)
    facts = materialise(with_payload_facts(index), "media-facts").join(F.broadcast(many), "digest", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    out = join_groups(rows, facts, "digest", "n", total)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "shard", "offset", "width", "height", "bit_depth")
