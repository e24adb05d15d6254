"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of a run of documents, one after the other, each id in the
fewest bits that hold the vocabulary.  Layout, little-endian:

    magic 8 bytes "GLIDS\\0\\0\\1"
    blocks: BLOCK ids each (the last may hold fewer), most significant bit first, padded to a byte
    block offsets: uint64 for each block, and one for the end of the last
    document starts: uint64 for each document, and one for the end of the last
    trailer: uint32 bits, uint32 ids in a block, uint64 documents, uint64 ids, magic

A reader seeks to the trailer, then to the tables, and unpacks only the blocks that
hold what it wants, with numpy.  Writers hold one block and the document starts of
their file in memory.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, encoder, runs, vocabulary_path

MAGIC = b"GLIDS\0\0\1"
BLOCK = 1 << 16
_TRAILER = struct.Struct("<IIQQ8s")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold ids from 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(wide).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def open_fs(path: str):
    """A pyarrow file system and the path in it; file:, hdfs:, s3: and others work alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_file(path: str, documents: Iterable[np.ndarray], bits: int) -> tuple[int, int]:
    """Write one file; it appears whole, by a rename, so a repeated task is harmless. Gives documents, ids."""
    system, name = open_fs(path)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    system.create_dir(name.rpartition("/")[0], recursive=True)
    offsets, starts, total = [len(MAGIC)], [0], 0
    held: list[np.ndarray] = []
    waiting = 0
    with system.open_output_stream(part) as out:
        out.write(MAGIC)

        def put(ids):
            data = pack(ids, bits)
            out.write(data)
            offsets.append(offsets[-1] + len(data))

        for ids in documents:
            total += len(ids)
            starts.append(total)
            held.append(ids)
            waiting += len(ids)
            if waiting >= BLOCK:
                row = np.concatenate(held)
                full = len(row) // BLOCK * BLOCK
                for i in range(0, full, BLOCK):
                    put(row[i : i + BLOCK])
                held, waiting = [row[full:]], len(row) - full
        if waiting:
            put(np.concatenate(held))
        out.write(np.array(offsets, "<u8").tobytes())
        out.write(np.array(starts, "<u8").tobytes())
        out.write(_TRAILER.pack(bits, BLOCK, len(starts) - 1, total, MAGIC))
    system.move(part, name)
    return len(starts) - 1, total


class IdFile:
    """Random access to one file: len(file), file[i] (document i's ids), file.read(start, n)."""

    def __init__(self, path: str):
        system, name = open_fs(path)
        self.f = system.open_input_file(name)
        size = self.f.size()
        self.f.seek(size - _TRAILER.size)
        self.bits, self.block, documents, self.total, magic = _TRAILER.unpack(self.f.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        blocks = -(-self.total // self.block)
        self.f.seek(size - _TRAILER.size - 8 * (documents + 1 + blocks + 1))
        self.offsets = np.frombuffer(self.f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.starts = np.frombuffer(self.f.read(8 * (documents + 1)), "<u8").astype(np.int64)

    def __len__(self):
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from place start on; only the blocks that hold them are read."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        self.f.seek(int(self.offsets[first]))
        data = self.f.read(int(self.offsets[last + 1] - self.offsets[first]))
        rows = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            to = int(self.offsets[b + 1] - self.offsets[first])
            rows.append(unpack(data[at:to], min(self.block, self.total - b * self.block), self.bits))
        return np.concatenate(rows)[start - first * self.block :][:n]

    def documents(self) -> Iterator[np.ndarray]:
        """Every document in turn; holds as many blocks as the longest document needs, and one more."""
        at, row, base = 0, np.zeros(0, np.uint32), 0
        while at < len(self):
            to = at + 1
            while to < len(self) and self.starts[to + 1] - self.starts[at] <= self.block:
                to += 1
            base, n = int(self.starts[at]), int(self.starts[to] - self.starts[at])
            row = self.read(base, n)
            for i in range(at, to):
                yield row[int(self.starts[i]) - base : int(self.starts[i + 1]) - base]
            at = to

    def close(self):
        self.f.close()


def write(docs: DataFrame, path: str, *, id_column="doc_id", text_column="text", vocabulary: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """Encode every text and write the ids in ascending order of id_column to token-id files under path.

    docs is range-partitioned by id (ties, as repeated rows: by a hash of the text), so
    file k's documents precede file k + 1's, and no id, however frequent, need share a file.
    A null text is empty and still gets the end id; null ids come first.  An empty table
    gives no files.  Returns the manifest, one row per file: shard, file, n_docs, n_tokens.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    tie = F.xxhash64(F.col("__text"))
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text")).select("__id", "__text", tie.alias("__tie"))
    rows = rows.repartitionByRange(common.partitions(spark), "__id", "__tie").sortWithinPartitions("__id", "__tie")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        code = encoder(vocabulary)
        bits = bits_for(code.vocabulary)
        ids: list = []

        def each():
            for pdf in common.trimmed(batches):
                texts = pdf["__text"].tolist()
                ids.append(pdf["__id"])
                for run in runs(texts):
                    for row in code.encode(texts[run]):
                        yield row if end_id is None else np.append(row, np.int32(end_id))

        each_row = each()
        first = next(each_row, None)
        if first is None:
            return
        file = f"{path}/part-{shard:06d}.glids"
        from itertools import chain

        n_docs, n_tokens = write_file(file, chain((first,), each_row), bits)
        keys = pd.concat(ids, ignore_index=True)
        key_file = f"{path}/part-{shard:06d}.keys"
        _write_keys(key_file, keys)
        yield pd.DataFrame({"shard": [shard], "file": [file], "keys": [key_file], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    manifest = rows.drop("__tie").mapInPandas(save, "shard long, file string, keys string, n_docs long, n_tokens long")
    return common.stored(manifest, "manifest")


def _write_keys(path: str, keys: pd.Series) -> None:
    """The documents' own ids, in file order, as one Arrow column."""
    import pyarrow as pa

    system, name = open_fs(path)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    column = pa.array(keys, from_pandas=True)
    table = pa.table({"id": column.cast(pa.int64()) if pa.types.is_floating(column.type) else column})
    with system.open_output_stream(part) as out, pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    system.move(part, name)


def _read_keys(path: str) -> list:
    import pyarrow as pa

    system, name = open_fs(path)
    with system.open_input_file(name) as f:
        return pa.ipc.open_file(f).read_all().column("id").to_pylist()


def scan(manifest: DataFrame, row: Callable, columns: str, id_type: str = "bigint") -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it) and row(ids) for every document, as columns says."""
    files = manifest.withColumn(
        "base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("shard", "file", "keys", "base")
    schema = f"doc_id {id_type}, start long, {columns}"
    fields = [c.split()[0] for c in schema.split(", ")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, keys, base in zip(pdf["file"], pdf["keys"], pdf["base"], strict=True):
                f, names = IdFile(file), _read_keys(keys)
                out, size = [], 0
                for at, ids in enumerate(f.documents()):
                    out.append((names[at], int(base + f.starts[at]), *row(ids)))
                    size += len(ids) + 100
                    if size >= 1 << 20:
                        yield pd.DataFrame(out, columns=fields)
                        out, size = [], 0
                f.close()
                if out:
                    yield pd.DataFrame(out, columns=fields)

    n = common.partitions(manifest.sparkSession)
    return files.repartition(n, "shard").mapInPandas(load, schema)


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start and ids (binary, little-endian uint32) of every document, from the files."""
    return scan(manifest, lambda ids: (ids.astype("<u4").tobytes(),), "ids binary", id_type)


def digest(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the ids in the files."""
    return scan(manifest, lambda ids: (len(ids), crc32_of(ids)), "n_tokens long, ids_crc32 long", id_type)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
