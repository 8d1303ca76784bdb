"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most `capacity` tokens. How pieces are packed depends on their lengths alone, so the
program is stated over the histogram of lengths, which has at most `capacity` entries however many pieces there
are: a configuration says how many pieces of each length share a sequence, and the fewest configurations are to
cover all pieces. It is solved by multiplicative weights. Each length carries a weight; a knapsack by dynamic
programming prices the configurations, over groups of lengths that are drawn anew in every round, so that a round
gives one full configuration for each group; the lengths that got covered lose weight. The weights are prices of
the dual program: divided by the value of the best configuration of all lengths, they add up to a lower bound of the
number of sequences, and rounds end when the rounded solution is within a thousandth of it. The fractional solution
is rounded down, and what is left over is packed by best fit over the remaining histogram. Where that doesn't come as
close, the rest is packed anew, each sequence from its longest piece on by the subset of all remaining lengths that fills
it best, the longest ones first, as short pieces are the easiest to place later; how much of the fractional solution
is kept is tried out, from all of it to nothing. At last full sequences are exchanged for two (`absorb`).

Only the histogram is gathered on the driver. Pieces are numbered within their length, salted, so that a length
which most pieces have (as `capacity` itself) is spread over all tasks, and look their place up in the table of
configurations, whose size is bounded by the histogram's.

Defined cases: a null text is empty and has the end id alone; a very long text is cut into pieces and nothing of it
is lost; repeated rows are packed each for itself; ties are
broken by the pieces' own values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .tokens import encode_texts

Configuration = tuple[tuple[int, int], ...]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            of, piece, length, crc = [], [], [], []
            for i, x in enumerate(encode_texts(tokenizer, batch.column(1))):
                ids = x + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    of.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            start = np.array(piece, np.int64) * capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return d.mapInArrow(cut, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(lengths: list[int], limits: list[int], values: list[float], capacity: int) -> list[tuple[int, int]]:
    """The (index, times) of greatest value that fit into capacity, each at most `limits` times."""
    items, sizes, worth = [], [], []
    for i, (size, limit) in enumerate(zip(lengths, limits, strict=True)):
        times, left = 1, min(limit, capacity // size)
        while left:  # parts of 1, 2, 4, ... and the rest make up any number
            times = min(times, left)
            items.append((i, times))
            sizes.append(size * times)
            worth.append(values[i] * times)
            left -= times
            times *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for k, (size, value) in enumerate(zip(sizes, worth, strict=True)):
        with_it = best[:-size] + value
        np.greater(with_it, best[size:], out=taken[k, size:])
        np.maximum(with_it, best[size:], out=best[size:])
    found: dict[int, int] = {}
    at = capacity
    for k in range(len(items) - 1, -1, -1):
        if taken[k, at]:
            i, times = items[k]
            found[i] = found.get(i, 0) + times
            at -= sizes[k]
    return sorted(found.items())


def most_valuable(lengths: np.ndarray, values: np.ndarray, capacity: int) -> float:
    """The value of the best configuration of all lengths, each as often as it fits."""
    by_size = np.zeros(capacity + 1)
    by_size[lengths] = values
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = (by_size[1 : room + 1] + best[room - 1 :: -1]).max()
    return float(best[capacity])


def lower_bound(lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int) -> float:
    """What the dual says: prices that no configuration exceeds 1 with add up to at most the fewest sequences."""
    return float((values * counts).sum() / most_valuable(lengths, values, capacity))


@dataclass
class Program:
    """The configuration program over a histogram, solved round by round.

    `weight` is what each length's pieces are worth together; a round deals the lengths into groups, prices a
    configuration for each and uses it; what got covered loses weight."""

    lengths: np.ndarray
    counts: np.ndarray
    capacity: int
    step: float
    group: int
    seed: int
    used: dict[Configuration, float] = field(default_factory=dict)

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        self.weight = self.counts * self.lengths / self.capacity
        self.prices = np.zeros(len(self.lengths))
        self.bound = max([self.weight.sum(), *(float((self.counts * x).sum()) for x in self._steps())])

    def _steps(self) -> Iterator[np.ndarray]:
        """Prices that no configuration exceeds 1 with: floor((k + 1) x) / k of a length's share x of the capacity, or
        x itself where (k + 1) x is whole."""
        for k in range(1, 17):
            parts, rest = np.divmod((k + 1) * self.lengths, self.capacity)
            yield np.where(rest == 0, self.lengths / self.capacity, parts / k)

    def round(self) -> None:
        covered = np.zeros(len(self.lengths))
        self.prices += self.weight / self.counts
        order = self.rng.permutation(len(self.lengths))
        for some in np.array_split(order, max(1, len(order) // self.group)):
            worth = self.weight[some] / self.counts[some]
            found = knapsack(self.lengths[some].tolist(), self.counts[some].tolist(), worth.tolist(), self.capacity)
            c = tuple((int(some[i]), n) for i, n in found)
            amount = self.step * min(self.counts[i] / n for i, n in c)
            self.used[c] = self.used.get(c, 0.0) + amount
            for i, n in c:
                covered[i] += amount * n
        self.weight *= np.exp(-covered / self.counts)
        self.weight /= self.weight.sum() / len(self.weight)

    def tighten(self) -> None:
        for prices in (self.weight / self.counts, self.prices):  # those of this round, and of all rounds together
            self.bound = max(self.bound, lower_bound(self.lengths, self.counts, prices, self.capacity))

    def whole(self, fulls: tuple[float, ...] = (0.0, 0.98, 0.995), subsets: bool = False) -> dict[Configuration, int]:
        """Whole numbers of configurations that cover every piece: how full one has to be to be worth its place is
        tried out."""
        return min((self._rounded(full, subsets) for full in fulls), key=lambda x: sum(x.values()))

    def _rounded(self, full: float, subsets: bool) -> dict[Configuration, int]:
        left = self.counts.copy()
        covered = np.zeros(len(left))
        for c, amount in self.used.items():
            for i, n in c:
                covered[i] += amount * n
        surplus = covered / left  # a length that is covered more than once gives its configurations a smaller share
        taken: dict[Configuration, int] = {}

        def take(c: Configuration, times: int) -> None:
            if times > 0:
                taken[c] = taken.get(c, 0) + times
                for i, n in c:
                    left[i] -= n * times

        filled = {c: sum(int(self.lengths[i]) * n for i, n in c) for c in self.used}
        for c, amount in self.used.items():
            if filled[c] >= full * self.capacity:
                take(c, int(min(amount / max(1.0, max(surplus[i] for i, _ in c)), min(left[i] // n for i, n in c))))
        for c in sorted(self.used, key=lambda c: (-c[-1][0], -filled[c])):
            if not subsets and filled[c] >= max(full, 0.995) * self.capacity:
                take(c, int(min(left[i] // n for i, n in c)))
        if subsets:
            for c, times in fill_by_subsets(self.lengths.tolist(), left.tolist(), self.capacity):
                take(c, times)
            return taken
        # the rest, from the longest: each sequence gets the longest piece that still fits, as often as there are enough
        there = [i for i in range(len(left)) if left[i]]
        sizes = [int(self.lengths[i]) for i in there]
        while there:
            room, c, at = self.capacity, [], len(there)
            while (at := bisect_right(sizes, room, 0, at) - 1) >= 0:
                n = min(int(left[there[at]]), room // sizes[at])
                c.append((there[at], n))
                room -= n * sizes[at]
            c.reverse()
            take(tuple(c), min(int(left[i]) // n for i, n in c))
            for i, _ in c:
                if not left[i]:
                    at = bisect_left(there, i)
                    del there[at], sizes[at]
        return taken


def fill_by_subsets(lengths: list[int], counts: list[int], capacity: int) -> Iterator[tuple[Configuration, int]]:
    """Configurations (index, times) that use up all pieces: the longest left, and of the others those that together
    fill its sequence best, longest first. Sums that the first lengths reach are bits of a number for each of them; a
    number is right until a count below it changes."""
    left, mask = counts[:], (1 << capacity + 1) - 1
    reached = [1] * (len(lengths) + 1)
    stale = 0  # reached[k] holds for k <= stale
    top = len(lengths) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        left[top] -= 1
        room = capacity - lengths[top]
        end = bisect_right(lengths, room, 0, top + 1)
        stale = min(stale, end)
        for k in range(stale, end):
            bits, size, times, n = reached[k], lengths[k], 1, min(left[k], capacity // lengths[k])
            while n:  # parts of 1, 2, 4, ... and the rest make up any number
                times = min(times, n)
                bits |= bits << size * times & mask
                n -= times
                times *= 2
            reached[k + 1] = bits
        target = (reached[end] & ((1 << room + 1) - 1)).bit_length() - 1
        taken = {top: 1}
        for k in range(end - 1, -1, -1):
            if not target:
                break
            n, size = min(left[k], target // lengths[k]), lengths[k]
            while n and not reached[k] >> target - n * size & 1:
                n -= 1
            if n:
                taken[k] = taken.get(k, 0) + n
                target -= n * size
        left[top] += 1
        copies = min(left[k] // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= n * copies
        stale = min(taken)
        yield tuple(sorted(taken.items())), copies


def exact_fill(pieces: list[int], room: int) -> list[int] | None:
    """Places of pieces that fill the room exactly, the later ones of the list first."""
    reached, mask = [1], (1 << room + 1) - 1
    for size in pieces:
        reached.append(reached[-1] | reached[-1] << size & mask)
    if not reached[-1] >> room & 1:
        return None
    found = []
    for k in range(len(pieces) - 1, -1, -1):
        if not reached[k] >> room & 1:
            found.append(k)
            room -= pieces[k]
    return found


def absorb(solution: dict[Configuration, int], lengths: list[int], capacity: int, sample: int = 48, tries: int = 400, most: int = 1 << 16, seed: int = 3) -> dict[Configuration, int]:
    """Fewer sequences by exchange: a full one is opened, two of its pieces are each filled up exactly from the pieces of
    those that aren't full, and its other pieces join these. So one full sequence more takes up a sequence's worth of
    the rest, which is packed anew at the end. Goes on until `tries` attempts in a row fail."""
    rng = random.Random(seed)
    total = lambda x: sum(x.values())
    size = lambda c: sum(lengths[i] * n for i, n in c)
    full = {c: n for c, n in solution.items() if size(c) == capacity}
    rest = [i for c, n in solution.items() if c not in full for i, times in c for _ in range(times * min(n, most))]
    if len(rest) > most or not full:
        return solution
    names = [c for c in full if sum(n for _, n in c) > 1]
    failed, loose = 0, sum(lengths[i] for i in rest)
    while names and failed < tries and loose > capacity:
        c = names[rng.randrange(len(names))]
        failed += 1
        if not full.get(c):
            continue
        own = [i for i, n in c for _ in range(n)]
        rng.shuffle(own)
        for k in range(len(rest) - 1, max(0, len(rest) - sample) - 1, -1):
            at = rng.randrange(k + 1)
            rest[k], rest[at] = rest[at], rest[k]
        some = rest[-sample:]
        made = []
        for x in own[:2]:
            at = exact_fill([lengths[i] for i in some], capacity - lengths[x])
            if at is None:
                break
            made.append(tuple(sorted(Counter([x, *(some[k] for k in at)]).items())))
            gone = set(at)
            some = [i for k, i in enumerate(some) if k not in gone]
        if len(made) < 2:
            continue
        failed = 0
        full[c] -= 1
        for new in made:
            if new not in full:
                names.append(new)
            full[new] = full.get(new, 0) + 1
        rest[-sample:] = some + own[2:]
        loose -= capacity
    left = Counter(rest)
    found = {c: n for c, n in full.items() if n}
    for c, times in fill_by_subsets(lengths, [left.get(i, 0) for i in range(len(lengths))], capacity):
        found[c] = found.get(c, 0) + times
    return found if total(found) < total(solution) else solution


def solve_with_bound(histogram: dict[int, int], capacity: int, rounds: int = 48, group: int = 256, step: float = 0.25, seed: int = 1,
                     close: float = 0.001) -> tuple[list[tuple[Configuration, int]], int]:
    """Configurations as (length, times) with the number of sequences of each, every piece in exactly one, and a
    lower bound to the number of all sequences. Rounds end early when the two are as `close` as that."""
    result: list[tuple[Configuration, int]] = []
    full = histogram.get(capacity, 0)
    if full:
        result.append((((capacity, 1),), full))
    lengths = np.array(sorted(x for x, n in histogram.items() if x < capacity and n), np.int64)
    if not len(lengths):
        return result, full
    program = Program(lengths, np.array([histogram[x] for x in lengths.tolist()], np.int64), capacity, step, group, seed)
    best: dict[Configuration, int] | None = None
    for k in range(1, rounds + 1):
        program.round()
        if k & (k - 1) == 0 or k == rounds:
            program.tighten()
            if k >= 4:
                best = min((x for x in (best, program.whole()) if x is not None), key=lambda x: sum(x.values()))
                if sum(best.values()) <= math.ceil(program.bound - 1e-6) * (1 + close):
                    break
    goal = math.ceil(program.bound - 1e-6)
    for full in (2.0, 0.0):
        if best is not None and sum(best.values()) > goal:
            best = min(best, absorb(program.whole((full,), subsets=True), lengths.tolist(), capacity), key=lambda x: sum(x.values()))
    result += [(tuple((int(lengths[i]), n) for i, n in c), times) for c, times in (best or program.whole()).items()]
    return result, full + math.ceil(program.bound - 1e-6)


def solve(histogram: dict[int, int], capacity: int, **options) -> list[tuple[Configuration, int]]:
    return solve_with_bound(histogram, capacity, **options)[0]


def places(solution: list[tuple[Configuration, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, times, first sequence, offset): pieces number from to to-1 of a length fill sequences
    from the first on, `times` in each, side by side from the offset."""
    rows, next_piece, sequence = [], {}, 0
    for c, copies in solution:
        offset = 0
        for length, times in reversed(c):
            start = next_piece.get(length, 0)
            next_piece[length] = start + times * copies
            rows.append((length, start, start + times * copies, times, sequence, offset))
            offset += length * times
        sequence += copies
    return rows


def pack(cut: DataFrame, capacity: int, salt: int = 64, **options) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32), which is read
    several times and so had better be written."""
    spark = cut.sparkSession
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salt = max(salt, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "p_length bigint, p_from bigint, p_to bigint, times bigint, first_sequence bigint, p_offset bigint"
    table = spark.createDataFrame(places(solve(by_length, capacity, **options)), schema)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salt)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("row", F.row_number().over(within)).join(bases, ["length", "salt"]).withColumn("k", F.col("base") + F.col("row") - 1)
    # the table has at most a row for each length of each configuration: lengths x (rounds x groups + lengths), whatever
    # the number of pieces
    placed = numbered.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("k") >= F.col("p_from")) & (F.col("k") < F.col("p_to")))
    nth = F.col("k") - F.col("p_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("times"))).cast("bigint").alias("sequence_id"),
        (F.col("p_offset") + F.pmod(nth, F.col("times")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text), "pack-pieces"), capacity)
