"""Media columns: content-addressed images in tar shards.

A document's payload, its UTF-8 bytes filled with zeros to a positive multiple of 64, becomes an 8-bit
greyscale PNG, 64 samples wide, one for each byte: lossless and compressed. The members of a shard
are named by the SHA-256 of the file. Rows carry digest, shard,
offset and length; width, height and depth come from range reads of the header alone, and the payload is
decoded from the stored bytes.

Equal texts are stored once for all: only their digests are shuffled, the copy with the smallest id is stored where it is read, and every
document gets its place by the digest. Only where that copy's row is itself repeated, or no copy has an id, one of its texts is picked by a
shuffle. The digests of texts with copies are broadcast while they are at most ``COPIES``; beyond that the texts are joined with them by a shuffle.

A task writes its own shards, to paths with its attempt's number, and emits rows only for closed ones, so
a task that is lost and run again leaves at most unused files. Shards go to the shared folder.

Nulls: a null text counts as the empty text, a payload of 64 zeros. Texts are stored whole, whatever their length. Repeated
rows point to the same bytes or equal ones. An empty table writes nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import materialize, prepare_python, shared_dir, table

WIDTH = 64
SHARD_BYTES = 64 << 20
LEVEL = 6
_SIGN = b"\x89PNG\r\n\x1a\n"
#: Signature and header chunk: what a metadata read fetches.
HEADER_BYTES = 33
#: So many digests of texts with copies are broadcast at most (32 bytes each).
COPIES = 200_000
SCHEMA = "doc_id long, key binary, n_bytes long, digest string, shard string, offset long, length long"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(payload, bytes without the filling)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, depth) from the first ``HEADER_BYTES``."""
    if head[:8] != _SIGN or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a file that to_png() wrote; checksums are verified."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, body = HEADER_BYTES, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _place(uri: str):
    """(file system, path): pyarrow's own for local, HDFS, S3, GCS and Azure."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Shard:
    """A tar file that is being written, member by member."""

    def __init__(self, folder: str, name: str):
        files, path = _place(folder)
        files.create_dir(path, recursive=True)
        self.uri, self.out, self.at, self.held = f"{folder}/{name}", files.open_output_stream(f"{path}/{name}"), 0, {}

    def add(self, data: bytes) -> tuple[str, int, int]:
        """(digest, offset, length)."""
        digest = hashlib.sha256(data).hexdigest()
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.held[digest] = self.at + len(head)
            self.at += len(head) + len(data) + -len(data) % 512
        return digest, self.held[digest], len(data)

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, key (the text's SHA-256), n_bytes, digest, shard, offset, length for every row of ``docs`` (doc_id, text); its tasks write the shards, with each action on the plan (see manifest()). Equal texts of a shard are one member."""
    return _stored(keyed(docs), folder, shard_bytes)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"))


def _stored(rows: DataFrame, folder: str | None, shard_bytes: int) -> DataFrame:
    spark = rows.sparkSession
    prepare_python(spark)
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, rows, n = None, [], 0

        def closed() -> pa.RecordBatch:
            shard.close()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array([shard.uri] * len(rows), pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())], names=["doc_id", "key", "n_bytes", "digest", "shard", "offset", "length"])

        for batch in batches:
            for doc_id, text, key in zip(*batch.columns, strict=True):
                if shard is None:
                    shard = _Shard(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{n}.tar")
                payload, size = payload_of(text.as_py())
                rows.append((doc_id.as_py(), key.as_py(), size, *shard.add(to_png(payload))))
                if shard.at >= shard_bytes:
                    yield closed()
                    shard, rows, n = None, [], n + 1
        if shard is not None:
            yield closed()

    return rows.select("doc_id", "text", "key").mapInArrow(run, SCHEMA)


def one_of_each(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, keys): doc_id, text, key of one row of each distinct text, and doc_id, key of all rows."""
    rows = keyed(docs)
    keys = materialize(rows.select("doc_id", "key"), "media-keys")
    copies = keys.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = keys.join(copies, "key").where("doc_id <=> owner").groupBy("key").agg(F.count(F.lit(1)).alias("n_same"))
    copies = materialize(copies.join(same, "key").withColumnRenamed("key", "k"), "media-copies")
    few = copies.limit(COPIES + 1).count() <= COPIES
    rows = rows.join(F.broadcast(copies) if few else copies, F.col("key") == F.col("k"), "left")
    texts = rows.where("k IS NULL OR (doc_id = owner AND n_same = 1)").select("doc_id", "text", "key")
    if not copies.where("n_same > 1 OR owner IS NULL").isEmpty():
        texts = texts.unionByName(rows.where("(n_same > 1 OR owner IS NULL) AND doc_id <=> owner").select("doc_id", "text", "key").dropDuplicates(["key"]))
    return texts, keys


def manifest(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(places, keys): store()'s rows, written once, one for each distinct text, and doc_id, key of all rows, which have their place by the key."""
    texts, keys = one_of_each(docs)
    return materialize(_stored(texts, folder, shard_bytes), "media-manifest"), keys


def features(payload: bytes) -> str:
    """Height, sum of the samples, distinct samples, and sum of the differences of neighbours."""
    x = np.frombuffer(payload, np.uint8)
    return f"h{len(x) // WIDTH}-s{int(x.sum(dtype=np.int64))}-d{len(np.unique(x))}-g{int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))}"


class _Reader:
    """Range reads of shards; one file is open at a time."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            files, path = _place(uri)
            self.uri, self.file = uri, files.open_input_file(path)
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{uri} ends before {offset + length}")
        return data


def with_headers(rows: DataFrame) -> DataFrame:
    """Adds width, height and depth to store()'s rows, from range reads of the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            heads = [png_header(reader.read(s.as_py(), o.as_py(), min(HEADER_BYTES, n.as_py()))) for s, o, n in zip(col["shard"], col["offset"], col["length"], strict=True)]
            w, h, d = zip(*heads, strict=True) if heads else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(d, pa.int32())], names=[*batch.schema.names, "width", "height", "depth"])

    return rows.mapInArrow(run, SCHEMA + ", width int, height int, depth int")


def read_back(rows: DataFrame) -> DataFrame:
    """with_headers()'s rows with what the stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            out = []
            for shard, offset, length, digest in zip(col["shard"], col["offset"], col["length"], col["digest"], strict=True):
                data = reader.read(shard.as_py(), offset.as_py(), length.as_py())
                own = hashlib.sha256(data).hexdigest()
                if own != digest.as_py():
                    raise OSError(f"{shard} doesn't hold {digest} at {offset}")
                payload = from_png(data)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), own, features(payload)))
            a, b, c, d, e = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.string())], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    return rows.mapInArrow(run, SCHEMA + ", width int, height int, depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def op9_media(spark, sf_dir: str) -> DataFrame:
    places, keys = manifest(table(spark, sf_dir, "documents"))
    digests = {c: F.unhex(c) for c in ("payload_sha256", "media_sha256")}  # half as long while they are shuffled
    told = read_back(with_headers(places)).drop("doc_id", "digest", "shard", "offset", "depth").withColumns(digests)
    out = keys.join(told, "key").withColumns({c: F.lower(F.hex(c)) for c in digests})
    return out.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "length AS media_bytes", "media_sha256", "feature", "width", "height")
