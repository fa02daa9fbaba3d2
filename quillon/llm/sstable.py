"""Token ids in sorted-string-table shards.

A shard holds documents in ascending id order: blocks of entries whose 8-byte big-endian keys are
prefix-compressed, each block packed with zstandard, then a Bloom filter of the ids, a sparse index
(first key, place and size of each block) and a fixed footer. lookup() reads footer, filter, index
and one block; scan() reads all.

Shards are written by tasks through pyarrow's filesystems to a new name each try and named in a
manifest table; files of tries that failed are never in the manifest.

Defined cases: null texts are empty documents (just the end id); null ids sort first and are held as
such; repeated ids are all kept, in the order of a hash of their text; very long texts are encoded whole, as one entry
of one block; an empty table gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, id_text, new_path, through
from quillon.llm.tokens import encoded, encoder

MAGIC = 0x514C4E5353543031
FOOTER = struct.Struct("<QQQQQQQ")  # filter place, size; index place, size; documents, tokens, magic
NULL_KEY = b""
BITS, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return NULL_KEY if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == NULL_KEY else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def places(key: bytes, bits: int) -> list[int]:
    h1, h2 = xxhash.xxh3_64_intdigest(key, 1), xxhash.xxh3_64_intdigest(key, 2) | 1
    return [(h1 + i * h2) % bits for i in range(HASHES)]


class Writer:
    """add() in ascending key order, then close() -> what the manifest says of the shard."""

    def __init__(self, sink, block_bytes: int = 256 * 1024):
        self.sink, self.block_bytes, self.at = sink, block_bytes, 0
        self.buf, self.index, self.keys, self.tokens, self.last, self.first = bytearray(), [], [], 0, b"", None
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype("<u4")
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = value.tobytes() if wide else value.astype("<u2").tobytes()
        if self.first is None:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(self.last, key)) if a != b), min(len(self.last), len(key)))
        self.buf += varint(shared) + varint(len(key) - shared) + varint(len(value) << 1 | wide) + key[shared:] + value
        self.last, self.tokens = key, self.tokens + len(ids)
        self.keys.append(key)
        if len(self.buf) >= self.block_bytes:
            self._block()

    def _block(self) -> None:
        if self.first is not None:
            data = self.pack.compress(bytes(self.buf))
            self.index.append((self.first, self.at, len(data)))
            self._put(data)
            self.buf, self.first = bytearray(), None

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> dict:
        self._block()
        bits = max(64, len(self.keys) * BITS + 7 & ~7)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._put(bytes(bloom))
        index_at = self.at
        self._put(b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index))
        self._put(FOOTER.pack(bloom_at, len(bloom), index_at, self.at - index_at, len(self.keys), self.tokens, MAGIC))
        return {"n_docs": len(self.keys), "n_tokens": self.tokens, "first_id": id_of(self.keys[0]), "last_id": id_of(self.keys[-1]), "n_bytes": self.at}


class Reader:
    """source: a seekable binary file of the given size."""

    def __init__(self, source, size: int):
        self.source = source
        bloom_at, bloom_n, index_at, index_n, self.n_docs, self.n_tokens, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom, raw, at, self.index = self._get(bloom_at, bloom_n), self._get(index_at, index_n), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            place, at = read_varint(raw, at)
            size_, at = read_varint(raw, at)
            self.index.append((key, place, size_))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, size = self.index[block]
        data, at, key = zstandard.ZstdDecompressor().decompress(self._get(place, size)), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            head, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            n = head >> 1
            yield key, np.frombuffer(data, "<u4" if head & 1 else "<u2", n // (4 if head & 1 else 2), at).astype(np.uint32)
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._entries(i):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The id sequences held under doc_id (none, one, or more if the id repeats)."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in places(key, bits)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            found += [ids for k, ids in self._entries(i) if k == key]
        return found


def open_fs(uri: str):
    """pyarrow filesystem and path of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode, sort by id, write shards under folder; return the manifest (one row a shard)."""
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = id_text(docs, id_col, text_col).repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, made, writer, sink = f"{base}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst", None, None, None
        enc = encoder(vocabulary)
        for b in batches:
            ids = b.column(0).to_pylist()
            if ids and writer is None:
                sink = fs.open_output_stream(name)
                writer = Writer(sink)
            for lo, hi, got, at in encoded(enc, b.column(1), end_id):
                for doc_id, start, end in zip(ids[lo:hi], at[:-1].tolist(), at[1:].tolist()):
                    writer.add(doc_id, got[start:end])
        enc.rest()
        if writer:
            made = writer.close()
            sink.close()
            made |= {"shard": TaskContext.get().partitionId(), "path": name}
        fields = [f.split() for f in MANIFEST.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([made[n]] if made else [], kinds[k]) for n, k in fields], [n for n, _ in fields])

    return cut(through(rows, run, MANIFEST), "manifest")


READ = "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""

    def run(batches):
        import pyarrow as pa

        fs, _ = open_fs(folder)
        for b in batches:
            for shard, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    at, rows = 0, []
                    for doc_id, ids in Reader(f, f.size()).scan():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in cols]], [x.split()[0] for x in READ.split(", ")])

    many = max(1, manifest.count())
    got = through(manifest.select("shard", "path").repartition(many), run, READ)
    before = manifest.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))
    return got.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", "shard")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write all of docs to shards in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "sst")
    return read(docs.sparkSession, write(docs, folder, vocabulary, end_id), folder)
