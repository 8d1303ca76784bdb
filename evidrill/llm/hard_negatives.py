"""Hard negatives by angular triangle filtering.

Rows are integer vectors (components scaled and rounded down). For each row its norm and its angles to a few reference
directions are stored. By the triangle inequality on the sphere the angle of two rows lies, for every reference, between
the difference and the sum of their angles to it (a sum beyond pi turns back); the intervals of all references
intersect. The cosines of its ends times both norms, rounded outward, bound the integer inner product, and only rows
whose bounds reach into a window that is asked for get integer scoring.

An anchor asks twice. Its positives, the best rows of its label: the window is all from the k-th best score among a
bounded sample, which the whole table can only raise. Its negatives: for each positive the scores from a share of the
positive's score up to it, of other labels, with the lower end raised in the same way.

References are directions that a bounded sample of `fit_rows` rows gathers around. Rows lie in cells, by their nearest
reference and how far they are from it; of each cell (at most `cells`) the driver knows the ranges of angles and norms. An
anchor is sent only to cells whose bounds overlap its windows. Cells are cut into blocks of bounded size, and where
anchors are very many each block is held for each share of them. A block is one key of a shuffle, in which its rows come
first and its anchors stream past them. Nothing else is gathered.

Where rows have no structure, as the given vectors, nearly all angles are alike and bounds exclude little.

Defined cases: a row without id or label, without a vector or with one that holds a null or a number that isn't finite
(scaled, too) takes no part, nor does a vector of another length than most; of several rows of an id the least, by label
and vector, counts, so repeated rows count once; zero vectors score 0; ties go to the smaller id; scores beyond 64 bits
are compared exactly up to 38 digits and given as the nearest 64-bit number; an anchor without positives or negatives has no row; an
empty table gives an empty result; other columns, also texts of any length, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .neighbours import matrix

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
#: Angles are stored in 32 bits; this is more than what that and their computation lose.
SLACK = 1e-6
EXACT = 1 << 52
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class References:
    directions: np.ndarray
    limits: np.ndarray

    def angles(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        scaled = x / np.where(norms > 0, norms, 1)[:, None]
        return np.arccos(np.clip(scaled @ self.directions.T, -1, 1)).astype(np.float32)

    def cell(self, angles: np.ndarray) -> np.ndarray:
        nearest = angles.argmin(axis=1)
        return nearest * (len(self.limits) + 1) + np.searchsorted(self.limits, angles.min(axis=1))


def fit(x: np.ndarray, n: int, cells: int, rounds: int = 5) -> References:
    """Directions far from each other, moved to the middle of the rows around each."""
    norms = np.sqrt((x * x).sum(axis=1))
    u = x[norms > 0] / norms[norms > 0, None]
    if not len(u):
        return References(np.eye(x.shape[1])[:1], np.zeros(0))
    chosen = [0]
    nearest = u @ u[0]
    while len(chosen) < min(n, len(u)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    d = u[chosen]
    for _ in range(rounds):
        of = (u @ d.T).argmax(axis=1)
        sums = np.zeros_like(d)
        np.add.at(sums, of, u)
        size = np.sqrt((sums * sums).sum(axis=1))
        d = np.where(size[:, None] > 1e-9, sums / np.where(size > 1e-9, size, 1)[:, None], d)
    bands = max(1, cells // len(d))
    closest = np.arccos(np.clip((u @ d.T).max(axis=1), -1, 1))
    return References(d, np.unique(np.quantile(closest, np.arange(1, bands) / bands)) if bands > 1 else np.zeros(0))


def score_bounds(angles_a: np.ndarray, norm_a: float, low: np.ndarray, high: np.ndarray, norms_low: np.ndarray, norms_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that rows can have whose angles lie from low to high (rows x references)."""
    near, far = np.zeros(len(low)), np.full(len(low), np.pi)
    for r, a in enumerate(angles_a.astype(np.float64)):
        lo, hi = low[:, r], high[:, r]
        np.maximum(near, np.maximum(lo - a, a - hi), out=near)
        # the sum, turned back at pi
        np.minimum(far, np.where(lo + a > np.pi, 2 * np.pi - lo - a, np.minimum(hi + a, np.pi)), out=far)
    top, bottom = np.cos(np.maximum(near - 2 * SLACK, 0)), np.cos(np.minimum(far + 2 * SLACK, np.pi))
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = norm_a * norms_low, norm_a * norms_high
        upper = np.where(top > 0, most, least) * top + most * 1e-9 + 1e-6
        lower = np.where(bottom > 0, least, most) * bottom - most * 1e-9 - 1e-6
    return np.where(np.isfinite(lower), np.ceil(lower), -np.inf), np.where(np.isfinite(upper), np.floor(upper), np.inf)


def scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles: exact, as 64-bit integers or else as Python's."""
    if len(x) and float(np.sqrt((x * x).sum(axis=1).max())) * float(np.sqrt(a @ a)) < EXACT:
        return np.rint(x @ a).astype(np.int64)
    own = [int(v) for v in a.tolist()]
    return np.array([sum(int(p) * q for p, q in zip(row, own, strict=True)) for row in x.tolist()], object)


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by (value descending, id)."""
    at = np.arange(len(values))
    if len(at) > 4 * k and values.dtype != object:
        at = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    return np.array(sorted(at.tolist(), key=lambda i: (-int(values[i]), int(ids[i])))[:k], np.int64)


def window_low(score: int, low: int, high: int) -> int:
    """The least integer s of high * s >= low * score."""
    return -(-low * score // high)


@dataclass
class Rows:
    """Rows of a block, or of the sample."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    angles: np.ndarray

    @classmethod
    def of(cls, t: pa.Table | pa.RecordBatch) -> Rows:
        return cls(t["id"].to_numpy(zero_copy_only=False), np.array(t["label"].to_pylist(), object), matrix(t["x"]).astype(np.float64), t["norm"].to_numpy(zero_copy_only=False), matrix(t["angles"]).astype(np.float64))

    def bounds(self, angles: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(angles, norm, self.angles, self.angles, self.norms, self.norms)

    def positives(self, own: int, label, a: np.ndarray, norm: float, angles: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best rows of the label, other than its own, that reach `floor`."""
        _, upper = self.bounds(angles, norm)
        at = np.flatnonzero((self.labels == label) & (self.ids != own) & (upper >= floor))
        if len(at) > 16 * k:  # the most promising ones raise the floor
            first = at[np.argpartition(-upper[at], 4 * k)[: 4 * k]]
            s = scores(self.x[first], a)
            floor = max(floor, float(sorted(s.tolist())[-k]) * (1 - 1e-12) - 1)
            at = at[upper[at] >= floor]
        s = scores(self.x[at], a)
        top = best(s, self.ids[at], k)
        return s[top], at[top]

    def negatives(self, label, a: np.ndarray, norm: float, angles: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores (both ends included) scores and places of the k best rows of other labels."""
        lower, upper = self.bounds(angles, norm)
        reached = np.zeros(len(self.ids), bool)
        for lo, hi in windows:
            reached |= (upper >= lo) & (lower <= hi)
        at = np.flatnonzero(reached & (self.labels != label))
        s = scores(self.x[at], a)
        out = []
        for lo, hi in windows:
            inside = np.flatnonzero((s >= lo) & (s <= hi))
            top = inside[best(s[inside], self.ids[at[inside]], k)]
            out.append((s[top], at[top]))
        return out


@dataclass(frozen=True)
class Plan:
    """What every task knows: the sample, the cells' ranges, into how many blocks each cell is cut."""

    sample: Rows
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norms: np.ndarray
    blocks: np.ndarray

    def route(self, angles: np.ndarray, norm: float, windows: list[tuple[float, float]]) -> list[tuple[int, int]]:
        """The blocks that can hold a score inside a window."""
        lower, upper = score_bounds(angles, norm, self.low, self.high, self.norms[:, 0], self.norms[:, 1])
        reached = np.zeros(len(self.cells), bool)
        for lo, hi in windows:
            reached |= (upper >= lo) & (lower <= hi)
        return [(int(self.cells[i]), j) for i in np.flatnonzero(reached) for j in range(int(self.blocks[i]))]


_ROW = "id bigint, label string, x array<double>, norm double, angles array<float>, cell int, is_anchor boolean"
_ASKED = "asked array<struct<id: bigint, low: decimal(38,0), high: decimal(38,0)>>"


def _streamed(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, a block's rows before its anchors: answer(rows, anchors) for each run of anchors."""
    key, held, rows = None, [], None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = np.stack([t[c].to_numpy() for c in ("to", "sub", "share", "asks")], axis=1)
        cuts = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if start == end:
                continue
            block, asks = tuple(keys[start, :3].tolist()), bool(keys[start, 3])
            if block != key:
                key, held, rows = block, [], None
            part = t.slice(start, end - start)
            if not asks:
                held.append(part.select(["id", "label", "x", "norm", "angles"]))
            elif held or rows is not None:
                if held:
                    rows, held = Rows.of(pa.concat_tables(held)), []
                yield answer(rows, part)


def _met(rows: DataFrame, anchors: DataFrame, plan: Plan, shares: int, answer, schema: str) -> DataFrame:
    """Every block with the anchors that are sent to it."""
    size = dict(zip(plan.cells.tolist(), plan.blocks.tolist(), strict=True))
    blocks = F.element_at(F.create_map(*[F.lit(v) for kv in size.items() for v in kv]), F.col("cell")) if size else F.lit(1)
    here = rows.select(
        "id", "label", "x", "norm", "angles", F.lit(None).cast(_ASKED.split(" ", 1)[1]).alias("asked"), F.col("cell").alias("to"),
        F.pmod(F.xxhash64("id"), blocks).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("asks"),
    )
    asking = anchors.withColumn("share", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(shares)).cast("int")).withColumn("asks", F.lit(1))
    both = here.unionByName(asking.select(*here.columns)).repartition("to", "sub", "share").sortWithinPartitions("to", "sub", "share", "asks")
    return both.mapInArrow(lambda batches: _streamed(batches, answer), schema)


def _sent(anchors: DataFrame, windows, plan: Plan) -> DataFrame:
    """A row for each anchor and block; windows(anchor) gives what it asks for as (id, low, high), and the windows of
    scores by which it is sent."""
    names = ["id", "label", "x", "norm", "angles", "asked", "to", "sub"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, asked, to, at = Rows.of(b), [], [], []
            for i in range(b.num_rows):
                wanted, ranges = windows(own, i, b)
                for cell, sub in plan.route(own.angles[i], float(own.norms[i]), ranges):
                    to.append((cell, sub))
                    at.append(i)
                    asked.append(wanted)
            if at:
                taken = b.select(["id", "label", "x", "norm", "angles"]).take(pa.array(at))
                kind = pa.list_(pa.struct([("id", pa.int64()), ("low", pa.decimal128(38, 0)), ("high", pa.decimal128(38, 0))]))
                more = [pa.array(asked, kind), pa.array([t for t, _ in to], pa.int32()), pa.array([s for _, s in to], pa.int32())]
                yield pa.RecordBatch.from_arrays([*taken.columns, *more], names)

    return anchors.mapInArrow(send, f"id bigint, label string, x array<double>, norm double, angles array<float>, {_ASKED}, to int, sub int")


def _decimal(v: int | float):
    """As decimal(38, 0): scores beyond that stay at its ends."""
    from decimal import Decimal

    most = 10**38 - 1
    return Decimal(int(min(max(v, -most), most)))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k: int = 5, n_positives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id",
         vector: str = "embedding", references: int = 16, cells: int = 1024, fit_rows: int = 8192, block_rows: int = 1 << 16, share_rows: int = 1 << 17) -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Negatives have low * positive_score <= high * score <= high * positive_score."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), F.transform(F.col(vector).cast("array<double>"), lambda c: c * scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
    v = v.groupBy("id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("r")).select("id", "r.*")
    v = materialize(v, "negatives-vectors")
    sizes = v.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None or not sizes["size"]:
        return spark.createDataFrame([], RESULT)
    v = v.where(F.size("v") == sizes["size"])
    n = v.count()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_block = max(4096, min(block_rows, -(-n // tasks)))
    sample = v.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()  # bounded
    model = fit(np.floor(matrix(sample["v"])), references, min(cells, -(-n // per_block)))

    def measured(ids, labels, values, anchors) -> pa.RecordBatch:
        x = np.floor(matrix(values))
        norms = np.sqrt((x * x).sum(axis=1))
        angles = model.angles(x, norms)
        lists = lambda y, kind: pa.FixedSizeListArray.from_arrays(pa.array(y.ravel(), kind), y.shape[1]).cast(pa.list_(kind))
        return pa.RecordBatch.from_arrays([ids, labels, lists(x, pa.float64()), pa.array(norms), lists(angles, pa.float32()), pa.array(model.cell(angles).astype(np.int32)), anchors], [c.split()[0] for c in _ROW.split(", ")])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield measured(*(b[c] for c in ("id", "label", "v", "is_anchor")))

    rows = materialize(v.select("id", "label", "v", "is_anchor").mapInArrow(measure, _ROW), "negatives-rows")
    n_refs = len(model.directions)
    angle = [F.get("angles", F.lit(r)) for r in range(n_refs)]
    ranges = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"),
        F.array(*[F.min(a) for a in angle]).alias("low"), F.array(*[F.max(a) for a in angle]).alias("high"),
    ).orderBy("cell").toArrow()  # a row for each cell
    kept = Rows.of(pa.Table.from_batches([measured(*(sample[c].combine_chunks() for c in ("id", "label", "v", "is_anchor")))]))
    plan = Plan(
        kept, ranges["cell"].to_numpy(), matrix(ranges["low"]).astype(np.float64), matrix(ranges["high"]).astype(np.float64),
        np.stack([ranges["norm_low"].to_numpy(), ranges["norm_high"].to_numpy()], axis=1), -(-ranges["n"].to_numpy() // per_block),
    )
    anchors = rows.where("is_anchor").select("id", "label", "x", "norm", "angles")
    shares = max(1, -(-anchors.count() // share_rows))

    def best_asked(own: Rows, i: int, batch) -> tuple[list, list]:
        s, _ = kept.positives(int(own.ids[i]), own.labels[i], own.x[i], float(own.norms[i]), own.angles[i], n_positives, -np.inf)
        floor = _decimal(int(s[-1])) if len(s) == n_positives else _decimal(-(10**39))
        return [{"id": int(own.ids[i]), "low": floor, "high": _decimal(10**39)}], [(float(floor) * (1 + 1e-12 if floor < 0 else 1 - 1e-12), np.inf)]

    def best_of_block(block: Rows, asking: pa.Table) -> pa.RecordBatch:
        own, found = Rows.of(asking), ([], [], [])
        for i, asked in enumerate(asking["asked"].to_pylist()):
            floor = float(asked[0]["low"])
            s, at = block.positives(int(own.ids[i]), own.labels[i], own.x[i], float(own.norms[i]), own.angles[i], n_positives, floor - abs(floor) * 1e-12)
            found[0].extend([int(own.ids[i])] * len(s))
            found[1].extend(block.ids[at].tolist())
            found[2].extend(_decimal(int(x)) for x in s)
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.decimal128(38, 0))], ["anchor_id", "row_id", "score"])

    best_rows = _met(rows, _sent(anchors, best_asked, plan), plan, shares, best_of_block, "anchor_id bigint, row_id bigint, score decimal(38,0)")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "row_id")
    positives = best_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    positives = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "row_id", "score"))).alias("positives"))
    positives = materialize(positives, "negatives-positives")
    asking = anchors.join(positives, anchors["id"] == positives["anchor_id"]).select("id", "label", "x", "norm", "angles", "positives")

    def windows_asked(own: Rows, i: int, batch) -> tuple[list, list]:
        wanted, ranges = [], []
        for p in batch["positives"][i].as_py():
            top = int(p["score"])
            bottom = window_low(top, low, high)
            if bottom > top:  # of a negative score nothing lies between
                continue
            wanted.append((p["row_id"], bottom, top))
        found = kept.negatives(own.labels[i], own.x[i], float(own.norms[i]), own.angles[i], [w[1:] for w in wanted], k)
        out = []
        for (row_id, bottom, top), (s, _) in zip(wanted, found, strict=True):
            if len(s) == k:
                bottom = max(bottom, int(s[-1]))
            out.append({"id": row_id, "low": _decimal(bottom), "high": _decimal(top)})
            ranges.append((bottom * (1 - 1e-12), top * (1 + 1e-12)))
        return out, ranges

    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def negatives_of_block(block: Rows, asking: pa.Table) -> pa.RecordBatch:
        own, found = Rows.of(asking), ([], [], [], [], [])
        for i, asked in enumerate(asking["asked"].to_pylist()):
            windows = [(int(w["low"]), int(w["high"])) for w in asked]
            for w, (s, at) in zip(asked, block.negatives(own.labels[i], own.x[i], float(own.norms[i]), own.angles[i], windows, k), strict=True):
                for column, values in zip(found, ([int(own.ids[i])] * len(s), [w["id"]] * len(s), block.ids[at].tolist(), [w["high"]] * len(s), [_decimal(int(x)) for x in s]), strict=True):
                    column.extend(values)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names)

    schema = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score decimal(38,0), negative_score decimal(38,0)"
    found = _met(rows, _sent(asking, windows_asked, plan), plan, shares, negatives_of_block, schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    long = lambda c: F.least(F.greatest(F.col(c), F.lit(-_MOST - 1).cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("bigint").alias(c)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", long("positive_score"), long("negative_score"))
