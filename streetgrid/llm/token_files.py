"""Token files with directly addressable codes (operator 5).

A file set is a folder of two Parquet tables. ``segments`` has one row for each segment of whole documents, in ascending
order of their ids. The ids of a segment are cut into chunks of 8 bits. Level 0 holds every id's lowest chunk and a bitmap
that tells whose next chunk follows in level 1, and so on. A directory with the number of set bits before each block of
512 bits gives the place in the next level, so any token is read with one look into each level and no block is decoded:
the files are not compressed and their pages are small, so that a look reads the pages of one segment. ``starts`` has the
number of ids before each shard.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import byte_symbols_of, plain_pieces, read_spec
from .chunk_cache import ChunkCache, chunks
from .common import slices, strings

#: A segment is closed when it holds so many ids; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 14
#: Bytes of a page of the files.
PAGE_BYTES = 1 << 15
#: Bits for each entry of a rank directory.
BLOCK_BITS = 512
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint32)

SEGMENT = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("shard_offset", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_lengths", T.ArrayType(T.LongType())),
        T.StructField("chunks", T.ArrayType(T.BinaryType())),
        T.StructField("bitmaps", T.ArrayType(T.BinaryType())),
        T.StructField("ranks", T.ArrayType(T.BinaryType())),
    ]
)


class AddressableCodes:
    """Integers below 2**32 in chunk levels; ``pack`` makes them, indexing reads one, ``ids`` reads all."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def pack(cls, ids: np.ndarray) -> AddressableCodes:
        levels, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            levels.append((rest & 0xFF).astype(np.uint8).tobytes())
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK_BITS // 8)) if len(bits) else np.zeros(0, np.uint32)
            bitmaps.append(bits.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
            rest = rest[more] >> 8
            if not len(rest):
                return cls(levels, bitmaps, ranks)

    def __len__(self) -> int:
        return len(self.levels[0])

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for level, bits, rank in zip(self.levels, self.bitmaps, self.ranks, strict=True):
            value |= level[i] << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            before = int.from_bytes(rank[4 * block : 4 * block + 4], "little")
            before += int.from_bytes(bits[first : i >> 3], "little").bit_count()
            i = before + (bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        value = None
        for level, bits in zip(reversed(self.levels), reversed(self.bitmaps), strict=True):
            own = np.frombuffer(level, np.uint8).astype(np.uint32)
            if value is not None:
                more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own), bitorder="little").astype(bool)
                own[more] |= value << 8
            value = own
        return value


class LibraryIds:
    """The library's ids of whole texts, as raw little-endian 32-bit integers.

    Chunks between blanks never merge across these, nor do a word and the marks behind it, so each such piece is encoded
    once and remembered while there is room. Plain pieces, which the library's normaliser would only lower-case and its
    splitter leave whole, go to the library's model at once; all others go through the whole library.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the library's threads would compete with other tasks
        self._tokenizer = Tokenizer.from_str(spec)
        self._model_tokens = self._tokenizer.model.tokenize
        self._of_piece = ChunkCache(self._piece)
        self._of_chunk = ChunkCache(self._chunk)

    def __call__(self, texts: list[str]) -> list[bytes]:
        get = self._of_chunk.__getitem__
        return [b"".join(map(get, chunks(t))) for t in texts]

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self._model_tokens(byte_symbols_of(piece))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        plain = plain_pieces(chunk)
        if plain is None:
            return array("I", self._tokenizer.encode(chunk, add_special_tokens=False).ids if chunk else ()).tobytes()
        return b"".join(map(self._of_piece.__getitem__, plain))


@lru_cache(maxsize=2)
def _library(spec: str) -> LibraryIds:
    """One encoder for each vocabulary and Python worker."""
    return LibraryIds(spec)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SEGMENT_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("shard_offset", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())),
        ("chunks", pa.list_(pa.binary())),
        ("bitmaps", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())),
    ]
)


def write(docs: DataFrame, vocab_path: str, path: str, end_id: int, partitions: int | None = None, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every document, append ``end_id`` and write the ids in ascending order of ``doc_id`` to the folder ``path``.

    A null or empty text is the end id alone; null ids come first; rows with one id stay apart, in any order. An empty
    table gives empty tables. Range partitions of the texts are encoded where they are sorted, so nothing is gathered;
    rows of one id, or of none, are parted by their texts.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocab_path))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _library(spec.value)
        shard, segment, offset = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        keys: list = []
        size = 0

        def close() -> pa.RecordBatch:
            codes = AddressableCodes.pack(np.frombuffer(b"".join(held), dtype="<u4"))
            row = (shard, segment, offset, size, keys, [len(h) // 4 for h in held], codes.levels, codes.bitmaps, codes.ranks)
            return _columns([row], _SEGMENT_ARROW)

        for batch in batches:
            for part in slices(batch):
                for key, ids in zip(part.column(0).to_pylist(), encode(strings(part.column(1))), strict=True):
                    ids += end
                    held.append(ids)
                    keys.append(key)
                    size += len(ids) // 4
                    if size >= SEGMENT_IDS:
                        yield close()
                        segment, offset, size, held, keys = segment + 1, offset + size, 0, [], []
        if held:
            yield close()

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id").mapInArrow(run, SEGMENT)
    ordered.write.options(**{"compression": "none", "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "false"}).mode("errorifexists").parquet(f"{path}/segments")
    # One row for each partition that was written.
    totals = _segments(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    totals.select("shard", starts.alias("start")).write.mode("errorifexists").parquet(f"{path}/starts")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(f"{path}/segments")


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Number of ids before each shard; one entry for each partition that was written."""
    return dict(spark.read.schema("shard int, start long").parquet(f"{path}/starts").collect())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file set: doc_id, start (ids of all documents before it), n_tokens and the raw ids, little-endian."""
    return _read(spark, path, T.StructField("ids", T.BinaryType()), pa.binary(), lambda raw: raw)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with the unsigned crc32 of each document's ids in place of these."""
    return _read(spark, path, T.StructField("ids_crc32", T.LongType()), pa.int64(), zlib.crc32)


def _read(spark: SparkSession, path: str, field: T.StructField, kind: pa.DataType, of) -> DataFrame:
    starts = spark.sparkContext.broadcast(shard_starts(spark, path))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (field.name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                ids = AddressableCodes(row["chunks"], row["bitmaps"], row["ranks"]).ids().astype("<u4")
                ends = np.cumsum(row["doc_lengths"])
                begins = ends - row["doc_lengths"]
                first = starts.value[row["shard"]] + row["shard_offset"]
                made = [of(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + first, pa.int64()), pa.array(row["doc_lengths"], pa.int64()), pa.array(made, kind)], schema=schema)

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), field])
    return _segments(spark, path).mapInArrow(run, out)


def token_at(spark: SparkSession, path: str, position: int) -> int | None:
    """The id at a position of the whole corpus, by a look into each level of one segment; None beyond the end."""
    starts = shard_starts(spark, path)
    before = [s for s, at in starts.items() if at <= position]
    if position < 0 or not before:
        return None
    shard = max(before, key=lambda s: (starts[s], s))
    local = position - starts[shard]
    row = _segments(spark, path).filter((F.col("shard") == shard) & (F.col("shard_offset") <= local) & (F.col("shard_offset") + F.col("n_ids") > local)).first()
    return None if row is None else AddressableCodes(row["chunks"], row["bitmaps"], row["ranks"])[local - row["shard_offset"]]
