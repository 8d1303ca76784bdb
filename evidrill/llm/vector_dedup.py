"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of a cosine of at least c lie within a squared distance of 2 - 2 c. Vectors are rotated onto the principal
axes of a bounded sample, and the axes are dealt into blocks of few dimensions and about equal variance. Each block has
the share of the squared distance that it has of the variance: by the pigeonhole rule two near vectors keep to the share
of some block. So every block is range-joined by itself, and the union of what it finds is verified on the vectors
themselves. A pair counts in the first block whose share it keeps to, so that it counts once without ever being
written: tasks give the number of links of each vector and a spanning forest of the links.

A range join cuts its block into cells by medians of the sample (a tree over the axes). A vector lies in one cell and
visits those of a lower number that its range reaches. Cells go by label. What lies in a cell is cut into tiles of
bounded size, and each pair of tiles is one group, whose blocks of rows are compared where their boxes are within range.
A hot cell so becomes many groups; its work grows with the square of its different vectors, which exact numbers of
links ask for, and its shuffle with that square over the tiles' size.

Equal vectors of a label are one entry with the number of its ids, so that copies cost nothing. Nothing is dropped or
capped. Vectors without structure reach most cells: then the join is one of all pairs within labels.

Defined cases: a vector that is null, zero, of another length than most or holds a null or a number that isn't finite
has no links, nor has one without label or id; it is kept, and its own component. Rows of the same id, label and vector
are one vector and get the same row each; rows of one id that differ are vectors of their own. A tie at the threshold is
a link. An empty table gives an empty result; other columns, also texts of any length, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, ship
from .components import connected_components
from .neighbours import matrix

#: More than what rotating loses of a squared distance between unit vectors.
SLACK = 1e-6
BROADCAST_ROWS = 100_000
#: Rows whose box is compared before they are.
RUN = 128


@dataclass(frozen=True)
class Tree:
    """Cells of one block: at each inner node (heap order) a coordinate and where it is cut."""

    axis: np.ndarray
    at: np.ndarray
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> Tree:
        axis, at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        members = {1: x}
        for node in range(1, 1 << depth):
            own = members.pop(node)
            if len(own):
                axis[node] = int(own.var(axis=0).argmax())
                at[node] = float(np.median(own[:, axis[node]]))
            right = own[:, axis[node]] > at[node]
            members[2 * node], members[2 * node + 1] = own[~right], own[right]
        return cls(axis, at, depth)

    def visited(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is its own) for each row's own cell and the lower ones within `reach`."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        own, gap = np.ones(len(x), bool), np.zeros(len(x))  # squared distance to the node's box, from below
        for _ in range(self.depth):
            d = x[row, self.axis[node]] - self.at[node]
            near = 2 * node + (d > 0)
            other = np.maximum(gap, d * d) <= reach * reach + 1e-9
            row, node = np.concatenate([row, row[other]]), np.concatenate([near, 4 * node[other] + 1 - near[other]])
            own, gap = np.concatenate([own, np.zeros(other.sum(), bool)]), np.concatenate([gap, np.maximum(gap, d * d)[other]])
        home = np.zeros(len(x), np.int64)
        home[row[own]] = node[own]
        kept = own | (node < home[row])
        return row[kept], node[kept], own[kept]


@dataclass(frozen=True)
class Subspaces:
    """The rotation (its axes in the order of the blocks), where blocks start, their budgets and trees."""

    rotation: np.ndarray
    starts: list[int]
    budgets: np.ndarray
    trees: list[Tree]

    @property
    def parts(self) -> list[tuple[int, int]]:
        return list(zip(self.starts[:-1], self.starts[1:], strict=True))

    def rotated(self, x: np.ndarray) -> np.ndarray:
        """Sums are built up axis by axis, so that every task finds the same numbers for a vector."""
        size = np.zeros(len(x))
        for c in x.T:
            size += c * c
        out, scaled = np.zeros(x.shape), x / np.sqrt(size)[:, None]
        for i, axis in enumerate(self.rotation):
            out += scaled[:, i, None] * axis
        return out


def fit(sample: np.ndarray, cosine: float, blocks: int, depth: int) -> Subspaces:
    u = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
    variance, axes = np.linalg.eigh(np.cov(u.T).reshape(u.shape[1], -1) if len(u) > 1 else np.eye(u.shape[1]))
    variance, axes = np.maximum(variance[::-1], 0), axes[:, ::-1]
    total = variance.sum()
    if total <= 0:
        variance, total = np.ones(len(variance)), float(len(variance))
    n = min(blocks, len(variance))
    while True:
        # dealt to and fro, so that blocks have about the same variance; fewer blocks where one has next to none
        place = np.arange(len(variance))
        of = np.where(place // n % 2, n - 1 - place % n, place % n)
        shares = np.array([variance[of == b].sum() for b in range(n)]) / total
        if n == 1 or shares.min() >= 1 / (4 * n):
            break
        n -= 1
    order = np.argsort(of, kind="stable")
    starts = [0, *np.cumsum(np.bincount(of, minlength=n)).tolist()]
    rotation = axes[:, order]
    r = u @ rotation
    return Subspaces(rotation, starts, (2 - 2 * cosine) * shares + SLACK, [Tree.fit(r[:, a:b], depth) for a, b in zip(starts[:-1], starts[1:], strict=True)])


def _sorted_runs(x: np.ndarray) -> np.ndarray:
    """An order in which runs of RUN rows have small boxes: halves by the widest axis, again and again."""
    pieces = [np.arange(len(x))]
    while max(map(len, pieces)) > RUN:
        halves = []
        for p in pieces:
            if len(p) <= RUN:
                halves.append(p)
                continue
            axis = int((x[p].max(axis=0) - x[p].min(axis=0)).argmax())
            middle = (len(p) // 2 + RUN - 1) // RUN * RUN
            p = p[np.argpartition(x[p, axis], min(middle, len(p) - 1))]
            halves += [p[:middle], p[middle:]]
        pieces = [p for p in halves if len(p)]
    return np.concatenate(pieces)


class Forest:
    """Sets of rows that links join."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]


def links_in(v: np.ndarray, r: np.ndarray, home: np.ndarray, tile: np.ndarray, pair: tuple[int, int], block: int, model: Subspaces,
             cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places (i, j) of one group: rows of two tiles (or of one with itself) of one cell."""
    start, end = model.parts[block]
    norms = np.sqrt(np.einsum("ij,ij->i", v, v))
    sides = [np.flatnonzero(tile == t) for t in dict.fromkeys(pair)]
    sides = [s[_sorted_runs(r[s, start:end])] for s in sides if len(s)]
    if len(sides) < len(set(pair)):
        return
    boxes = []
    for s in sides:
        cuts = np.arange(0, len(s), RUN)
        x = r[s, start:end]
        boxes.append((cuts, np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts), x, (x * x).sum(axis=1)))
    left, right = (0, len(sides) - 1)
    (cuts, low, high, x, xx), (cuts2, low2, high2, y, yy) = boxes[left], boxes[right]
    budget = model.budgets[block]
    for k, c in enumerate(cuts.tolist()):
        gap = np.maximum(0, np.maximum(low2 - high[k], low[k] - high2))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= budget)
        if left == right:
            near = near[near >= k]
        if not len(near):
            continue
        own = np.arange(c, min(c + RUN, len(x)))
        other = np.concatenate([np.arange(cuts2[m], min(cuts2[m] + RUN, len(y))) for m in near])
        d = xx[own, None] + yy[None, other] - 2 * (x[own] @ y[other].T)
        i, j = np.nonzero(d <= budget + 1e-9)
        if left == right:
            upper = own[i] < other[j]
            i, j = i[upper], j[upper]
        i, j = sides[left][own[i]], sides[right][other[j]]
        met = home[i] | home[j]  # a pair counts in the lower one of their cells
        i, j = i[met], j[met]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            linked = np.einsum("ij,ij->i", v[p], v[q]) / (norms[p] * norms[q]) >= cosine
            p, q = p[linked], q[linked]
            first = np.full(len(p), -1)
            for b, (s, e) in enumerate(model.parts[: block + 1]):
                apart = np.zeros(len(p))
                for axis in range(s, e):  # one after the other, as above
                    apart += (r[p, axis] - r[q, axis]) ** 2
                first = np.where((first < 0) & (apart <= model.budgets[b]), b, first)
            yield p[first == block], q[first == block]


def classes(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector: str = "embedding", blocks: int = 4, fit_rows: int = 8192,
            cell_rows: int = 1 << 15, max_cells: int = 4096, tile_rows: int = 4096) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    stored = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = materialize(rows.select("id", F.when(usable, row_key(F.col("label"), F.col("v"))).alias("key"), F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("v")).cast(stored).alias("v")), "classes-rows")
    nothing = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sizes = rows.where("key IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return nothing
    valid = rows.where((F.col("key").isNotNull()) & (F.size("v") == sizes["size"]))
    # equal vectors of a label are one entry
    ids = valid.select("key", "id").distinct().groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"))
    entries = valid.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")).join(ids, "key")
    entries = materialize(entries, "classes-entries")
    most = entries.groupBy("label").count().agg(F.max("count")).first()[0]
    sample = entries.select("v").orderBy(F.xxhash64("key"), "key").limit(fit_rows).toArrow()
    depth = max(0, (min(max_cells, -(-most // cell_rows)) - 1).bit_length())
    model = fit(matrix(sample["v"]).astype(np.float64), cosine, blocks, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = model.rotated(matrix(b["v"]).astype(np.float64))
            for k, (start, end) in enumerate(model.parts):
                row, cell, own = model.trees[k].visited(r[:, start:end], float(np.sqrt(model.budgets[k])))
                taken = [c.take(pa.array(row)) for c in (b["key"], b["m"], b["label"], b["v"])]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(np.full(len(row), k, np.int32)), pa.array(cell.astype(np.int32)), pa.array(own)], names)

    names = ["key", "m", "label", "v", "block", "cell", "home"]
    placed = entries.select("key", "m", "label", "v").mapInArrow(place, f"key bigint, m bigint, label string, v {stored}, block int, cell int, home boolean")
    by = ["label", "block", "cell"]
    tiles = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    tiles = materialize(tiles, "classes-tiles")
    small = tiles.count() <= BROADCAST_ROWS
    placed = placed.join(F.broadcast(tiles) if small else tiles, by)
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = placed.select("key", "m", "v", "home", "tile", *by, F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"))

    def joined(t: pa.Table) -> pa.Table:
        x, key, m = matrix(t["v"]).astype(np.float64), t["key"].to_numpy(), t["m"].to_numpy()
        r = model.rotated(x)
        one = lambda c: int(t[c][0].as_py())
        degree, forest = np.zeros(len(key), np.int64), Forest(len(key))
        for i, j in links_in(x, r, t["home"].to_numpy(), t["tile"].to_numpy(), (one("t1"), one("t2")), one("block"), model, cosine):
            np.add.at(degree, i, m[j])
            np.add.at(degree, j, m[i])
            forest.join(i, j)
        linked, hung = np.flatnonzero(degree), np.flatnonzero(forest.parent != np.arange(len(key)))
        columns = [np.concatenate([key[linked], key[hung]]), np.concatenate([np.zeros(len(linked), np.int64), key[forest.parent[hung]]]), np.concatenate([degree[linked], np.zeros(len(hung), np.int64)])]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])

    found = grouped.groupBy(*by, "t1", "t2").applyInArrow(joined, "a bigint, b bigint, n bigint")
    found = materialize(found, "classes-links")
    degrees = found.where("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "key")
    known = entries.select("key", "least", "m").join(degrees, "key", "left").join(components, "key", "left").where("m > 1 OR component IS NOT NULL")
    known = materialize(known.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "key").alias("component")), "classes-known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("key", "links", "component_id")
    out = rows.select("id", "key").join(known, "key", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
