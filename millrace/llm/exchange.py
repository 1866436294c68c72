"""Blocks of documents that ask buckets of keys, and get answers back.

A block is a few megabytes of texts, chosen by their hash; a bucket is a share of all keys (windows, n-grams). A block
sends each bucket what it has of its keys once, however often it occurs in the block, packed and compressed; a bucket
answers each block for the keys it sent, in the order it sent them; the block, formed again from the same documents,
applies the answers. So a frequent key sends at most one entry a block, and the occurrences themselves never travel.
Orders depend on the set of documents in a block alone, so a block that is computed anew after a loss agrees with the
answers. A block or bucket is one partition: tasks are even, and none waits for a neighbour.

Copies that together would fill a good part of a block stand apart: their text goes through the exchange once, with its
number, and its result is joined to the rows. There is no bound on the number of blocks or on the words of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

#: Bytes of text to a block, and how few where a small corpus would leave cores idle.
BLOCK_BYTES, LEAST_BYTES = 8 << 20, 1 << 20
#: Bytes that a row costs besides its text, and bytes of copies of one text from which these stand apart.
ROW_BYTES, APART_BYTES = 64, 1 << 20
#: Up to so many texts that stand apart are broadcast (their hashes, then their results).
BROADCAST_TEXTS = 20_000
#: Blocks beyond so many share partitions, evenly; buckets are at most so many, so that a row holds several keys of a
#: block on average and the number of rows grows with the input, not with blocks times buckets.
MAX_PARTITIONS, MAX_BUCKETS = 1 << 14, 1 << 18
#: Bytes of input that are packed together on their way to the blocks.
PACK_BYTES = 32 << 20


@dataclass
class Blocks:
    """``loose``: rows(__text, __h1, ...) not yet dealt; ``alone``: packed rows, see packed(), of texts for themselves;
    ``apart``: the same of texts that stand for many rows, with blocks from n on; ``rows``: those rows. The last two are
    None if there are none. ``few``: the texts that stand apart may be broadcast."""

    n: int
    text_col: str
    columns: list[str]
    loose: DataFrame
    alone: DataFrame
    apart: DataFrame | None = None
    rows: DataFrame | None = None
    few: bool = True

    @property
    def buckets(self) -> int:
        return min(self.n, MAX_BUCKETS)

    def asked(self, send: Callable, sent: T.StructType, answer: Callable, told: T.StructType) -> DataFrame:
        """What answer() tells of each bucket of send()'s rows of all blocks, a partition to a few blocks."""
        rows = [x.groupBy("__block").applyInArrow(send, sent) for x in (self.alone, self.apart) if x is not None]
        rows = rows[0] if len(rows) == 1 else rows[0].union(rows[1])
        return dealt(rows, "bucket", self.buckets).groupBy("bucket").applyInArrow(answer, told)

    def applied(self, told: DataFrame, make: Callable, made: T.StructType, with_text: bool) -> DataFrame:
        """The rows with the columns that make(documents, answers) makes of each block and what it was told."""
        back = dealt(told, "block", self.n).groupBy("block")
        names = [c for c in self.columns if with_text or c != self.text_col]
        own = [F.col("__text" if c == self.text_col else f"row.`{c}`").alias(c) for c in names]
        kept = T.StructType([f for f in self.loose.schema if f.name in ("row", "__text")[: 1 + with_text]])
        out = self.alone.groupBy("__block").cogroup(back).applyInArrow(_made(make, kept, made), T.StructType(kept.fields + made.fields)).select(*own, *made.names)
        if self.apart is None:
            return out
        kept = T.StructType([self.loose.schema["__h1"], self.loose.schema["__h2"]])
        results = self.apart.groupBy("__block").cogroup(back).applyInArrow(_made(make, kept, made), T.StructType(kept.fields + made.fields))
        results = results.withColumnsRenamed({"__h1": "__r1", "__h2": "__r2"})
        results = F.broadcast(results) if self.few else results
        return out.union(self.rows.join(results, (F.col("__r1") == F.col("__h1")) & (F.col("__r2") == F.col("__h2"))).select(*own, *made.names))


def _made(make: Callable, kept: T.StructType, made: T.StructType):
    schema = to_arrow_schema(T.StructType(kept.fields + made.fields))

    def apply(block: pa.Table, told: pa.Table) -> pa.Table:
        if not len(block):
            return schema.empty_table()
        documents = Documents(block)
        columns = [pa.array([None if t is None else t.decode() for t in documents.raw], pa.string()) if c == "__text" else documents.column(c) for c in kept.names]
        return pa.Table.from_arrays([*columns, *(pa.array(x, f.type) for x, f in zip(make(documents, told), list(schema)[len(kept) :], strict=True))], schema=schema)

    return apply


def packed(df: DataFrame, n: int) -> DataFrame:
    """df with a row for each block and some megabytes of input: columns as lists, texts together and compressed."""
    others = [f for f in df.schema if f.name not in ("__block", "__text")]
    out = T.StructType([df.schema["__block"], T.StructField("__texts", T.BinaryType()), T.StructField("__sizes", T.BinaryType()), *[T.StructField(f.name, T.ArrayType(f.dataType, f.nullable)) for f in others]])
    schema = to_arrow_schema(out)

    def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        order = np.argsort(t.column("__block").to_numpy(), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        block, text = t.column("__block").to_numpy(), t.column("__text").combine_chunks().cast(pa.large_binary())
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        cuts = runs(block)
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        sizes, data = np.where(text.is_null().to_numpy(zero_copy_only=False), -1, np.diff(at)), memoryview(text.buffers()[2] or b"")
        lists = lambda f: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays(t.column(f.name).chunks), schema.field(f.name).type)
        pairs = list(zip(cuts, cuts[1:]))  # noqa: B905
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array([pack(data[at[i] : at[j]]) for i, j in pairs], pa.binary()), pa.array([pack_numbers(sizes[i:j]) for i, j in pairs], pa.binary()), *map(lists, others)], schema=schema)

    def apply(batches):
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield together(held)
                held, size = [], 0
        if held:
            yield together(held)

    return dealt(df.mapInArrow(apply, out), "__block", n)


class Documents:
    """A block's packed rows, opened."""

    def __init__(self, block: pa.Table):
        self.block, self.number = block, block.column("__block")[0].as_py()
        self.raw: list[bytes | None] = []
        for data, sizes in zip(block.column("__texts").to_pylist(), block.column("__sizes").to_pylist(), strict=True):
            data, at = unpack(data), 0
            for n in unpack_numbers(sizes).tolist():
                self.raw.append(None if n < 0 else data[at : at + n])
                at += max(n, 0)

    @property
    def texts(self) -> list[bytes]:
        """Null is empty."""
        return [t or b"" for t in self.raw]

    def column(self, name: str) -> pa.Array:
        return pa.concat_arrays([c.flatten() for c in self.block.column(name).chunks])


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with the rows of a key in one partition and keys 0 to n - 1 dealt evenly."""
    return df.repartitionById(min(n, MAX_PARTITIONS), F.col(key))


def blocked(docs: DataFrame, text_col: str, train_col: str | None = None, block_bytes: int | None = None) -> Blocks:
    """docs in blocks. ``train_col``: a boolean that is no column of the result; its true rows are counted in __train."""
    size = block_bytes or BLOCK_BYTES
    train = F.col(train_col).cast("long") if train_col else F.lit(1).cast("long")
    columns = [c for c in docs.columns if c != train_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col], F.lit(0).alias("__"))
    source = docs.select(row.alias("row"), F.col(text_col).alias("__text"), F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2"), train.alias("__train"))
    weight = (F.coalesce(F.octet_length("__text"), F.lit(0)) + ROW_BYTES).cast("long")
    sizes = written(source.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("times"), F.sum(weight).alias("bytes")), "sizes")
    many = (F.col("times") > 1) & (F.col("bytes") > min(APART_BYTES, size // 2))
    total, n_many = sizes.agg(F.coalesce(F.sum(F.when(many, F.col("bytes") / F.col("times")).otherwise(F.col("bytes"))), F.lit(0.0)), F.count_if(many)).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n = max(1, round(total / size), min(2 * cores, int(total / min(LEAST_BYTES, size))))
    block = (F.pmod(F.col("__h1"), F.lit(n))).cast("int")
    one = F.lit(1).cast("long").alias("__times")
    loose = source.select("row", "__text", "__h1", "__h2")
    alone = lambda df: packed(df.select(block.alias("__block"), "__text", "row", one, "__train"), n)
    if not n_many:
        return Blocks(n, text_col, columns, loose, alone(source))
    few = n_many <= BROADCAST_TEXTS
    apart = sizes.where(many).select(F.col("__h1").alias("__a1"), F.col("__h2").alias("__a2"))
    apart = F.broadcast(apart) if few else apart
    same = (F.col("__h1") == F.col("__a1")) & (F.col("__h2") == F.col("__a2"))
    rows = source.join(apart, same, "left_semi")
    once = rows.groupBy("__h1", "__h2").agg(F.min("__text").alias("__text"), F.count(F.lit(1)).alias("__times"), F.sum("__train").alias("__train"))
    once = packed(once.select((block + n).alias("__block"), "__text", "__h1", "__h2", "__times", "__train"), n)
    return Blocks(n, text_col, columns, loose, alone(source.join(apart, same, "left_anti")), once, rows.select("row", "__text", "__h1", "__h2"), few)


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: small numbers and small differences become short."""
    return pack(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_numbers(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(8, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, np.uint64), dtype=np.uint64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start; the array's length last."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])
