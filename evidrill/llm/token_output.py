"""Token ids in a binary form, with Elias-Fano encoded document boundaries.

The format: a folder of Parquet files whose rows are blocks. A block holds the ids of some documents one after
the other (`ids`, unsigned little-endian integers of `width` bytes, 2 where the vocabulary allows) and two
Elias-Fano sequences: the documents' ends, and their ids less the block's first one. In such a sequence `low` has the
lower bits of each number, packed; `high` has the upper parts in unary, as a bit for each number and a zero for each
step; `ranks` has the place of every 64th one. A number is found by select on `high` and a look at `low`, in about
2 + log2(range / numbers) bits each, without a table of 64-bit offsets. Blocks go by (part, block); parts and the
documents in them go by ascending document id.

Texts are encoded where they are and only ids are shuffled, once, to parts that quantiles of the document ids tell
beforehand. Spark writes the blocks, so a lost executor's part is
written anew and nothing half-written stays.

Defined cases: a null text is empty: its document holds the end id alone; a very long text is one document of a block
of its size; a null document id comes first; repeated rows are documents of their own, next to each other; rows of one
document id go by part and their ids' bytes; an empty table gives a folder without blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship
from .tokens import encode_texts

SELECT_EVERY = 64
BLOCK_IDS = 1 << 19
FURTHEST = 1 << 62
BROADCAST_ROWS = 100_000


class EliasFano:
    """A sequence of ascending integers."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, ranks: bytes):
        self.n, self.bits, self.low, self.high, self.ranks = n, bits, low, high, ranks
        self._ones = np.frombuffer(ranks, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = values & ((1 << bits) - 1)
        low_bits = (low[:, None] >> np.arange(bits)) & 1
        places = (values >> bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, pack(low_bits), pack(high), places[::SELECT_EVERY].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The place of one number i in `high`: from the sample before it, byte by byte."""
        at, left = int(self._ones[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = self.high[at // 8] >> at % 8 << at % 8
        at = at // 8
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        return at * 8 + (byte & -byte).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        low, start = 0, i * self.bits
        if self.bits:
            end = start + self.bits
            window = int.from_bytes(self.low[start // 8 : (end + 7) // 8], "little")
            low = window >> start % 8 & ((1 << self.bits) - 1)
        return (self.select(i) - i) << self.bits | low

    def decode(self) -> np.ndarray:
        """All values."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.bits]
        low = low.reshape(self.n, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64)) if self.bits else 0
        return (ones - np.arange(self.n)) << self.bits | low


def largest_id(tokenizer: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())


def _bounds(d: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the documents into `parts` parts of about one size: what is gathered grows with the parts alone."""
    found = d.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    return np.array(sorted(map(int, found)), np.int64)


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, bounds: np.ndarray) -> DataFrame:
    """Per document: part, doc_id and ids, with the end id. An id that is several bounds at once has as many parts,
    which its documents are dealt to by their ids' checksums."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, kind = np.array([end_id], f"<u{width}").tobytes(), f"<u{width}"
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in encode_texts(tokenizer, batch.column(1))]
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = pc.fill_null(batch.column(0), 0).to_numpy()
            low, high = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
            crc = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            part = np.where(named, low + crc % (high - low + 1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    return docs.mapInArrow(encode, "part int, doc_id bigint, ids binary")


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text",
          block_ids: int = BLOCK_IDS, part_rows: int = 1 << 20) -> None:
    """Encode all texts and write them to the folder `out`."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 if largest_id(tokenizer, end_id) < 1 << 16 else 4
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // part_rows))
    bounds = _bounds(d, parts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, ids, ends, held = 0, [], [], []

        def block() -> pa.RecordBatch:
            named = [x for x in held if x is not None]
            first = named[0] if named else None
            at, by = EliasFano.encode(np.array(ends)), EliasFano.encode(np.array([x - first for x in named], np.int64))
            flat = b"".join(ids)
            values = [part, number, len(held), len(held) - len(named), first, by.bits, by.low, by.high, by.ranks, width, len(flat) // width, flat, at.bits, at.low, at.high, at.ranks]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for doc_id, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and (ends[-1] >= block_ids or (doc_id is not None and held[0] is not None and doc_id - held[0] >= FURTHEST) or (held[0] is None) != (doc_id is None)):
                    yield block()
                    number, ids, ends, held = number + 1, [], [], []
                ids.append(x.as_py())
                ends.append((ends[-1] if ends else 0) + len(ids[-1]) // width)
                held.append(doc_id)
        if held:
            yield block()

    b, n, i = pa.binary(), pa.int64(), pa.int32()
    names, types = zip(*[("part", i), ("block", i), ("n_docs", i), ("n_unnamed", i), ("first_id", n), ("id_bits", i), ("id_low", b), ("id_high", b), ("id_ranks", b),
                         ("width", i), ("n_ids", n), ("ids", b), ("ef_bits", i), ("ef_low", b), ("ef_high", b), ("ef_ranks", b)], strict=True)
    spark_name = {b: "binary", n: "bigint", i: "int"}
    schema = ", ".join(f"{name} {spark_name[t]}" for name, t in zip(names, types, strict=True))
    ids = _encoded(d, tokenizer, end_id, width, bounds).repartitionById(parts, F.col("part"))
    ordered = ids.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(blocks, schema).write.option("parquet.block.size", 16 << 20).parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids (binary, 32 bits each)."""
    return _documents(spark, path, "ids binary", lambda ids: (ids, pa.binary()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids_crc32."""
    return _documents(spark, path, "ids_crc32 bigint", lambda ids: (list(map(zlib.crc32, ids)), pa.int64()))


def _documents(spark: SparkSession, path: str, column: str, of) -> DataFrame:
    ship(spark)
    blocks = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k] for name in batch.schema.names}
                sequence = lambda n, x: EliasFano(n, *(r[f"{x}_{y}"].as_py() for y in ("bits", "low", "high", "ranks")))  # noqa: B023, E731
                n, unnamed = r["n_docs"].as_py(), r["n_unnamed"].as_py()
                at, by = sequence(n, "ef"), sequence(n - unnamed, "id")
                first = r["first_id"].as_py()
                ends = [at[i] for i in range(n)]
                starts = [0, *ends[:-1]]
                held = [None] * unnamed + [first + by[i] for i in range(n - unnamed)]
                flat = np.frombuffer(r["ids"].as_buffer(), f"<u{r['width'].as_py()}").astype("<u4")
                what, kind = of([flat[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"].as_py()] * n, pa.int32()), pa.array([r["block"].as_py()] * n, pa.int32()), pa.array(held, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(what, kind)],
                    ["part", "block", "doc_id", "start_in_block", "n_tokens", column.split()[0]],
                )

    held = blocks.mapInArrow(decode, f"part int, block int, doc_id bigint, start_in_block bigint, n_tokens bigint, {column}")
    # sums of whole parts first, a row for each; then those of the blocks of each part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("block_start")).join(parts, "part")
    if blocks.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return held.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("start_in_block")).cast("bigint").alias("start"), "n_tokens", column.split()[0]
    )
