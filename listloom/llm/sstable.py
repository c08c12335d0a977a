"""Operator 2: token ids in sorted-string-table shards.

Documents are range-partitioned by id, encoded and written as one shard file for each partition, in ascending id order.
A shard is a sequence of blocks, a sparse block index, a Bloom filter and a footer:

    block    entries of (shared key bytes, other key bytes, value bytes: varints; other key bytes; value), every
             ``RESTART``-th key whole; then the restart offsets and their number (u32), and crc32 of all that
    index    for each block: last key (with 7 bytes to fill up), offset, length, ids before it in this shard
    bloom    k, bits, bit array
    footer   offsets and lengths of index and bloom, number of entries and of ids, width, magic

Keys are nine bytes: a flag, 0 for a null id, and the id as 8 big-endian bytes with the sign bit flipped, so that bytes sort
as numbers and null comes first; values are ids as unsigned 16- or 32-bit little-endian integers (a flag in the footer).
``lookup`` finds the shard by its first key, then reads that shard's footer, Bloom filter, index and one block. Files are
named by partition and moved into place when whole, so a task that runs again leaves the same file; the places of shards in
the whole order are prefix sums over ranges of shards.

Defined results: a null text is empty (its ids are the end id alone); rows with a null id come first; repeated rows of an
id are entries of their own, ordered by a hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, new_folder, running_totals, ship, stored, table
from .tokens import default_path, encoder

MAGIC = b"LLSST01\n"
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
SHARD_BYTES = 32 << 20
#: Tasks that read shards back, at most.
READERS = 10_000
END_ID = 0
_FOOTER = struct.Struct("<6QI8s")


KEY = 9
_INDEX = struct.Struct("<9s7x3Q")


def key_bytes(key: int | None) -> bytes:
    return bytes(KEY) if key is None else struct.pack(">BQ", 1, key + 2**63)


def key_of(data: bytes) -> int | None:
    there, key = struct.unpack(">BQ", data)
    return key - 2**63 if there else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[int | None], bits: int) -> np.ndarray:
    h = np.array([-(2**63) if k is None else k for k in keys], dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    step = (h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(33) | np.uint64(1)
    return ((h[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class Writer:
    """Writes entries, in key order, to a binary stream."""

    def __init__(self, stream, wide: bool = False):
        self.out, self.wide, self.at = stream, wide, 0
        self.block, self.restarts, self.n_in_block, self.last = bytearray(), [], 0, b""
        self.index, self.keys, self.n_ids, self.ids_at_block = [], [], 0, 0

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        k = key_bytes(key)
        shared = 0
        if self.n_in_block % RESTART:
            while shared < KEY and k[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + k[shared:] + value
        self.n_in_block += 1
        self.last = k
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.n_in_block:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            place = self._put(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append((self.last, *place, self.ids_at_block))
            self.block, self.restarts, self.n_in_block, self.ids_at_block = bytearray(), [], 0, self.n_ids

    def finish(self) -> None:
        self._end_block()
        index = self._put(b"".join(_INDEX.pack(*x) for x in self.index))
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        field = np.zeros(bits, dtype=bool)
        if self.keys:
            field[_bloom_places(self.keys, bits)] = True
        bloom = self._put(np.packbits(field, bitorder="little").tobytes())
        self._put(_FOOTER.pack(*index, *bloom, len(self.keys), self.n_ids, int(self.wide), MAGIC))


class Reader:
    """Reads a shard through a random-access file: all entries in order, or one by key."""

    def __init__(self, file, size: int):
        self.file = file
        *places, self.n, self.n_ids, wide, magic = _FOOTER.unpack(self._get(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.kind = "<u4" if wide else "<u2"
        raw = self._get(*places[:2])
        self.index = list(_INDEX.iter_unpack(raw))
        self.bloom = places[2:]

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, block: int):
        _, at, n, _ = self.index[block]
        data = self._get(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {block} is damaged")
        (restarts,) = struct.unpack("<I", data[-8:-4])
        end, at, key = n - 8 - 4 * restarts, 0, b""
        while at < end:
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, dtype=self.kind, count=length // int(self.kind[-1]), offset=at)
            at += length

    def __iter__(self):
        for block in range(len(self.index)):
            for key, ids in self._entries(block):
                yield key_of(key), ids

    def lookup(self, key: int | None) -> np.ndarray | None:
        """Ids of a key (of its first entry), or None."""
        from bisect import bisect_left

        at, n = self.bloom
        field = np.frombuffer(self._get(at, n), dtype=np.uint8)
        places = _bloom_places([key], n * 8)[0]
        if not np.all(field[places >> 3] >> (places & 7).astype(np.uint8) & 1):
            return None
        k = key_bytes(key)
        block = bisect_left([x[0] for x in self.index], k)
        if block < len(self.index):
            for found, ids in self._entries(block):
                if found == k:
                    return ids
        return None


def write_shards(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; path, first (key), n (entries), ids of each, as a stored table of a small row a file."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    # rows that share an id are dealt out by their texts too, so that they need not fit one shard
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(max(1, -(-size // shard_bytes)), "k", "h").sortWithinPartitions("k", "h", "t").withColumn("p", F.spark_partition_id())

    def write(batches):
        files, path = filesystem(folder)
        writer = None
        encode = encoder(tokenizer)
        wide = encode.library.get_vocab_size() > 65536
        for batch in batches:
            keys, texts, parts = batch.column("k").to_pylist(), batch.column("t"), batch.column("p")
            if writer is None and keys:
                name = f"{path}/{parts[0].as_py():08d}.sst"
                # a second attempt of the task writes under a name of its own and replaces an equal file
                part = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                files.create_dir(path, recursive=True)
                stream = files.open_output_stream(part)
                writer = Writer(stream, wide)
            for a in range(0, len(keys), 512):
                for key, ids in zip(keys[a : a + 512], encode.encode(texts.slice(a, 512).to_pylist()), strict=True):
                    writer.add(key, np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(END_ID)))
        if writer is not None:
            writer.finish()
            stream.close()
            files.move(part, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "first": pa.array([writer.keys[0]], pa.int64()), "n": [len(writer.keys)], "ids": [writer.n_ids]})

    return stored(rows.select("k", "t", "p").mapInArrow(write, "path string, first long, n long, ids long"), "shards")


def read_shards(folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard of every entry, from the files."""
    listed = running_totals(shards, ["first", "path"], "ids").select("path", F.col("place").alias("shard"), F.col("before").alias("start"))
    # one file a task while there are few of them
    listed = listed.repartition(max(1, min(shards.count(), READERS)), "shard")

    def read(batches):
        files, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(row["path"]) as file:
                    out, at = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}, row["start"]
                    for key, ids in Reader(file, file.size()):
                        for name, x in zip(out, (key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            out[name].append(x)
                        at += len(ids)
                    columns = [pa.array(x, pa.int64()) for x in out.values()]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([row["shard"]] * len(columns[0]), pa.int64())], names=[*out, "shard"])

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def lookup(folder: str, shards: DataFrame, key: int) -> np.ndarray | None:
    """Ids of a key (of its first entry) in the shards of a folder, or None. The shard is found by its first key; rows of one id
    may go on into shards that begin with it, and the first of them may end the shard before."""
    first = F.struct(F.col("first").isNotNull().alias("there"), "first", "path")
    below = (F.col("first") < key) | F.col("first").isNull()
    row = shards.agg(F.max(F.when(below, first)).alias("before"), F.min(F.when(F.col("first") == key, first)).alias("at")).first()
    for place in (row["before"], row["at"]):
        if place is not None:
            files, _ = filesystem(folder)
            with files.open_input_file(place["path"]) as file:
                ids = Reader(file, file.size()).lookup(key)
            if ids is not None:
                return ids
    return None


def op2_sstable(spark, sf_dir):
    folder = new_folder(spark, "sstable")
    return read_shards(folder, write_shards(table(spark, sf_dir, "documents"), folder, default_path()))
