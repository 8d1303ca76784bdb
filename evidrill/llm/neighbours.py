"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of their principal components under rotations that are learned to lie near
the corners of the cube (iterative quantization), fitted to a bounded sample of `fit_rows` rows. Every row is
indexed. Codes of m substrings of 16 bits have an index for each substring, from its value to the rows that hold it.
By the pigeonhole rule codes that differ in less than m (t + 1) bits differ in at most t bits of some substring, so
probing all values within t bits of the query's substrings retrieves every code within that radius. Only retrieved
rows are compared, by their codes; those within the radius are ranked by the vectors themselves.

The radius grows from 0: once k rows are found, the distance of the k-th says how far the codes of nearer rows can
be. That relation (how many bits of a code differ at a distance, with a margin of `margin` standard deviations) is
learned from the sample. Where near copies abound a query touches few rows; where the nearest neighbours are far, as
for vectors without structure, the radius that recall needs is wide and most rows are touched.

Equal vectors share one entry with their smallest k + 1 ids, so that copies cost nothing. Entries are dealt into
blocks, queries into others; each pair of blocks is one group with an index of its own, and gives its k nearest
for each query. No side is broadcast or gathered.

Defined cases: a vector that is null, zero, of another length than most or holds a null or a number that isn't
finite takes no part; repeated rows count once; ties go to the smaller id; where there are fewer than k other
vectors all are returned; an empty table gives an empty result; other columns, also a text of any length, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

RESULT = "query_id bigint, rank int, vec_id bigint, score double"
WORD = 64


@dataclass(frozen=True)
class Codes:
    """The mean, the projection onto all bits, and at which distances of vectors how many bits differ."""

    mean: np.ndarray
    projection: np.ndarray
    distance: np.ndarray
    apart: np.ndarray
    margin: float

    def of(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors.astype(np.float64) - self.mean) @ self.projection > 0
        return np.packbits(bits, axis=1, bitorder="little")

    def radius(self, distance: float) -> int:
        """How many bits nearly all rows within a distance differ in at most."""
        bits = self.projection.shape[1]
        p = float(np.interp(distance, self.distance, self.apart)) / bits
        return min(bits, int(np.ceil(bits * p + self.margin * np.sqrt(bits * p * (1 - p)))))


def rotation(v: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """The rotation of v that lies nearest to the signs of what it gives."""
    r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of a and of b, as codes of bytes."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    return sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.int16) for k in range(x.shape[1]))


def fit(sample: np.ndarray, bits: int, k: int, margin: float, rounds: int = 20, probes: int = 512, seed: int = 5) -> Codes:
    x = sample.astype(np.float64)
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(np.cov((x - mean).T).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[: min(WORD, x.shape[1])].T
    rng = np.random.default_rng(seed)
    v = (x - mean) @ axes
    turns = [rotation(v, rounds, rng) for _ in range(-(-bits // axes.shape[1]))]
    projection = np.concatenate([axes @ r for r in turns], axis=1)[:, :bits]
    codes = Codes(mean, projection, np.zeros(1), np.zeros(1), margin)
    own, some = codes.of(x), rng.permutation(len(x))[:probes]
    d = np.sqrt(np.maximum(0, ((x[some] ** 2).sum(1)[:, None] + (x**2).sum(1)[None]) - 2 * x[some] @ x.T))
    # the nearest rows of each probe and some others, in bins of alike distance
    near = np.concatenate([np.argsort(d, axis=1, kind="stable")[:, : 4 * k], rng.integers(0, len(x), (len(some), 4 * k))], axis=1)
    far = np.take_along_axis(d, near, axis=1).ravel()
    apart = np.take_along_axis(hamming(own[some], own), near, axis=1).ravel()
    order = np.argsort(far, kind="stable")
    bins = [b for b in np.array_split(order, 64) if len(b)]
    distance = np.array([0.0, *(far[b].mean() for b in bins)])
    return Codes(mean, projection, distance, np.maximum.accumulate([0.0, *(apart[b].mean() for b in bins)]), margin)


#: All values of a substring, those with fewer bits first, and where those with more than so many bits start.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << 16)), kind="stable")
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16)), minlength=17))


class Index:
    """For each substring of the codes, from its value to the rows that hold it."""

    def __init__(self, codes: np.ndarray):
        self.codes, parts = codes, codes.view(np.uint16)
        n, self.m = parts.shape
        self.rows = np.concatenate([np.argsort(parts[:, j], kind="stable") for j in range(self.m)])
        held = [np.bincount(parts[:, j], minlength=1 << 16) for j in range(self.m)]
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(held))])
        self.base = np.arange(self.m)[:, None] << 16

    def probe(self, code: np.ndarray, bits: int, to: int) -> np.ndarray:
        """Rows, some more than once, of which some substring differs from the code's in `bits` to `to` - 1 bits."""
        masks = _MASKS[(_WITHIN[bits - 1] if bits else 0) : _WITHIN[to - 1]]
        bucket = (self.base + (code.view(np.uint16)[:, None] ^ masks)).ravel()
        start = self.starts[bucket]
        size = self.starts[bucket + 1] - start
        held = size > 0
        start, size = start[held], size[held]
        ends = np.cumsum(size)
        return self.rows[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def nearest_in_block(ids: list[np.ndarray], x: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, q: np.ndarray, queries: np.ndarray,
                     model: Codes, k: int) -> tuple[list, list, list, int]:
    """The k nearest of one block for each query (query ids, ids, distances), and how many rows probing touched."""
    out_q, out_v, out_s, touched = [], [], [], 0
    least = min(k + 1, len(rows))
    index = Index(rows)
    m, bits = index.m, model.projection.shape[1]
    x64, codes = x.astype(np.float64), rows.view(np.uint64)
    for i in range(len(q)):
        own, code, vector = int(query_ids[i]), queries[i].view(np.uint64), q[i].astype(np.float64)
        seen = np.zeros(len(rows), bool)
        there = apart = np.zeros(0, np.int64)  # retrieved rows outside the radius
        near, far = np.zeros(0, np.int64), np.zeros(0)  # retrieved rows within it, and their distances
        probed, radius = 0, m - 1
        while True:
            to = min(17, radius // m + 1)
            if to > probed:
                fresh = np.zeros(len(rows), bool)
                fresh[index.probe(queries[i], probed, to)] = True
                new = np.flatnonzero(fresh & ~seen)
                seen |= fresh
                there = np.concatenate([there, new])
                apart = np.concatenate([apart, np.bitwise_count(codes[new] ^ code).sum(axis=1)])
                probed = to
            inside = apart <= radius
            new, there, apart = there[inside], there[~inside], apart[~inside]
            near = np.concatenate([near, new])
            far = np.concatenate([far, np.sqrt(((x64[new] - vector) ** 2).sum(axis=1))])
            if len(far) >= least:
                need = model.radius(float(np.partition(far, least - 1)[least - 1]))
                if need <= radius or radius >= bits:
                    break
                # a step at a time, as nearer rows make what is needed smaller
                radius = min(need, max(radius + 4 * m, need - 2 * m))
            elif radius >= bits:
                raise ValueError("the index lacks rows")
            else:
                radius = min(bits, radius + 2 * m)
        touched += int(seen.sum())
        if len(far) > least:
            some = far <= np.partition(far, least - 1)[least - 1]
            near, far = near[some], far[some]
        pairs = sorted((s, v) for s, e in zip(far.tolist(), near.tolist(), strict=True) for v in ids[e].tolist() if v != own)[:k]
        out_q += [own] * len(pairs)
        out_s += [s for s, _ in pairs]
        out_v += [v for _, v in pairs]
    return out_q, out_v, out_s, touched


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", bits: int = 64,
           fit_rows: int = 8192, margin: float = 1.0, block_rows: int = 1 << 16, query_rows: int = 1 << 14) -> DataFrame:
    """Per query and neighbour: query_id, rank, vec_id, score (the Euclidean distance)."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = v.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0)).dropDuplicates(["id", "v"])
    v = materialize(v, "neighbours-vectors")
    sizes = v.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    v = v.where(F.size("v") == sizes["size"])
    # a bounded sample for the fit: fit_rows rows by a hash of their ids
    sample = v.select("v").orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
    model = fit(matrix(sample["v"]), bits, k, margin)

    def encode(batches):
        for b in batches:
            if b.num_rows:
                code = model.of(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*b.schema.names, "code"])

    smallest = Window.partitionBy("v").orderBy("id")
    entries = v.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = materialize(entries.select("ids", "v").mapInArrow(encode, "ids array<bigint>, v array<double>, code binary"), "neighbours-index")
    queries = v.where("is_query").select("id", "v").mapInArrow(encode, "id bigint, v array<double>, code binary")
    n, n_queries = index.count(), v.where("is_query").count()
    # blocks of at most about block_rows entries; smaller ones where that keeps more tasks busy
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(-(-n // block_rows), min(-(-n // 4096), tasks))
    query_blocks = max(1, -(-n_queries // query_rows))
    left = index.withColumn("rb", F.pmod(F.xxhash64("ids"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        found: tuple = ([], [], [])
        if rows.num_rows and asked.num_rows:
            ids = [x.values.to_numpy() for x in rows["ids"]]
            codes = [np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (rows, asked)]
            found = nearest_in_block(ids, matrix(rows["v"]), codes[0], asked["id"].to_numpy(), matrix(asked["v"]), codes[1], model, k)[:3]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], names)

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(nearest, "query_id bigint, vec_id bigint, score double")
    by_nearness = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_nearness)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
