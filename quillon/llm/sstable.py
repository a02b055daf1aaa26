"""Token ids in sorted-string-table shards.

A shard file holds its documents in ascending order of their key, the id as
eight big-endian bytes with the sign flipped (a null id is the empty key, which
sorts first). Entries are grouped in blocks: a key is written as the length of
the prefix that it shares with the key before it and the rest; every
`RESTART`-th key is whole, and a block ends with the places of those. Blocks are
compressed each. After them come the sparse index (last key, offset, length,
tokens before), a Bloom filter of the keys, and a footer with the offsets and
checksums. A lookup tests the filter, binary-searches the index for the one
block, and in it the whole keys.

Spark range-partitions and sorts the documents; each task streams one shard to
the shared folder under a temporary name and renames it, so that a repeated task
leaves the same file.

Defined results: a null text has the end id alone; repeated ids are all kept, in
the order of a hash of the text; an empty table gives no shards and an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import bounded_batches, new_path, text_or_empty
from quillon.llm.tokens import encoder, with_end

MAGIC = b"QSSTABL1"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES, RESTART = 256 << 10, 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "shard int, file string, first_key binary, last_key binary, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def bloom_bits(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2)
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Streams sorted (key, value) pairs to an open file."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width, self.offset = sink, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys, self.n_tokens, self.block_tokens, self.first = [], 0, 0, None

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.entries, self.last = self.entries + 1, key
        self.first = key if self.first is None else self.first
        self.keys.append(key)
        self.n_tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def _flush(self) -> None:
        if not self.entries:
            return
        tail = np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
        data = self.pack(bytes(self.block) + tail)
        self.index.append((self.last, self.offset, len(data), self.block_tokens))
        self._put(data)
        self.block, self.restarts, self.entries, self.block_tokens = bytearray(), [], 0, self.n_tokens

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQQ", *rest) for k, *rest in self.index)
        bits = 64 * (1 + len(self.keys) * BLOOM_BITS // 64)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[bloom_bits(k, bits)] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        places = (self.offset, len(index), self.offset + len(index), len(bloom), len(self.keys), self.n_tokens)
        self._put(index + bloom)
        self._put(FOOTER.pack(*places, zlib.crc32(index + bloom), self.width, MAGIC))


class ShardReader:
    """Reads a shard's footer, index and filter, and blocks as they are asked for."""

    def __init__(self, file: str) -> None:
        store, path = pafs.FileSystem.from_uri(file)
        self.source = store.open_input_file(path)
        size = self.source.size()
        at, n_index, at_bloom, n_bloom, self.n_docs, self.n_tokens, crc, self.width, magic = FOOTER.unpack(
            self.source.read_at(FOOTER.size, size - FOOTER.size)
        )
        meta = self.source.read_at(n_index + n_bloom, at)
        if magic != MAGIC or zlib.crc32(meta) != crc:
            raise ValueError(f"{file} is damaged")
        self.bloom, self.index, k = meta[n_index:], [], 0
        while k < n_index:
            n, k = _read_varint(meta, k)
            self.index.append((meta[k : k + n], *struct.unpack_from("<QQQ", meta, k + n)))
            k += n + 24
        self.lasts = [x[0] for x in self.index]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def block(self, i: int) -> tuple[bytes, list[int]]:
        """The entries of a block, and where whole keys begin."""
        _, at, n, _ = self.index[i]
        data = self.unpack(self.source.read_at(n, at))
        count = struct.unpack_from("<I", data, len(data) - 4)[0]
        cut = len(data) - 4 * (count + 1)
        return data[:cut], np.frombuffer(data, "<u4", count, cut).tolist()

    def entries(self, data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.entries(self.block(i)[0])

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, 8 * len(self.bloom)))

    def get(self, key: bytes) -> list[bytes]:
        """Values of all entries with this key."""
        found = []
        if not self.may_hold(key):
            return found
        for i in range(bisect.bisect_left(self.lasts, key), len(self.index)):
            data, restarts = self.block(i)
            # The last whole key below the sought one; equal keys may lie on both sides of a restart.
            at = bisect.bisect_left(restarts, key, key=lambda r: next(self.entries(data, r))[0])
            for k, v in self.entries(data, restarts[max(at - 1, 0)]):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
        return found


@dataclass(frozen=True)
class Manifest:
    """The shards in order; `starts` has the tokens before each."""

    shards: list
    starts: list[int]


def write_sstables(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Manifest:
    """Write shards of all documents below path, ordered by id across shards; the list of shards is all that the driver gets."""

    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        shard = TaskContext.get().partitionId()
        file = f"{path}/shard-{shard:06d}.sst"
        store, at = pafs.FileSystem.from_uri(file)
        writer, part = None, f"{at}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            if writer is None:
                store.create_dir(at.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(part)
                writer = ShardWriter(sink, enc.width)
            for k, ids in zip(batch["_key"].to_pylist(), with_end(enc, batch["_text"], end_id), strict=True):
                writer.add(key_of(k), ids.tobytes())
        if writer is not None:
            writer.close()
            sink.close()
            store.move(part, at)
            row = (shard, file, writer.first, writer.last, len(writer.keys), writer.n_tokens, writer.offset)
            yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in MANIFEST.split(", ")], row, strict=True))], schema=manifest)

    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    manifest = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MANIFEST.split(", ")])
    rows = (
        docs.select(F.col(id_col).cast("long").alias("_key"), text_or_empty(text_col).alias("_text"))
        .withColumn("_hash", F.xxhash64("_text"))
        .repartitionByRange("_key", "_hash")
        .sortWithinPartitions("_key", "_hash")
        .select("_key", "_text")
    )
    shards = sorted(rows.mapInArrow(write, MANIFEST).collect(), key=lambda r: r["shard"])
    starts = np.cumsum([0, *[r["n_tokens"] for r in shards]]).tolist()
    return Manifest(shards, starts[:-1])


def read_sstables(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for frame in frames:
            for file, start in zip(frame["file"], frame["start"], strict=True):
                reader, rows = ShardReader(file), []
                for key, value in reader.scan():
                    ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    files = [(r["shard"], r["file"], s) for r, s in zip(manifest.shards, manifest.starts, strict=True)]
    table = spark.createDataFrame(files, "shard int, file string, start long").repartition(max(1, len(files)))
    return table.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(ids: DataFrame, manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """doc_id and tokens (array of int) for each stored document whose id is asked for.

    The keys are sent to the shards that may hold them, whose key ranges are as
    many as there are files; each task opens only its own shards.
    """
    lasts, firsts = [r["last_key"] for r in manifest.shards], [r["first_key"] for r in manifest.shards]
    files = [r["file"] for r in manifest.shards]

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id in frame["doc_id"].tolist():
                key = key_of(doc_id)
                rows += [(doc_id, s) for s in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pd.DataFrame(rows, columns=["doc_id", "_shard"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers: dict[int, ShardReader] = {}
        for frame in frames:
            rows = []
            for doc_id, s in zip(frame["doc_id"].tolist(), frame["_shard"].tolist(), strict=True):
                reader = readers[s] = readers.get(s) or ShardReader(files[s])
                rows += [(doc_id, np.frombuffer(v, f"<u{reader.width}").astype(np.int32)) for v in reader.get(key_of(doc_id))]
            yield pd.DataFrame(rows, columns=["doc_id", "tokens"])

    keys = ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    routed = keys.mapInPandas(route, "doc_id long, _shard int").repartition("_shard")
    return routed.mapInPandas(search, "doc_id long, tokens array<int>")


def token_shards(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write all documents to new shards in the shared folder and report on them from the files."""
    spark = docs.sparkSession
    return read_sstables(spark, write_sstables(docs, tokenizer_path, new_path(spark, "sstables"), **options))
