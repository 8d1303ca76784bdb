"""N-gram Jaccard self-join with PartEnum signatures.

A document is its set of hashed shingles of `n` words. Sizes fall into bands, each an instance of its own: any two
sets that can be similar share an instance, in which they differ in at most k shingles. The instance deals the
shingle domain into n1 partitions and each into 3 parts. Of n1 partitions more than k / 2 leave one, with at most
one difference, so one of the partition's three pairs of parts is equal in both sets: the hash of a pair is a
signature, and similar sets share one. A pair of parts without any shingle says nothing. Where all shingles of a
partition are in one part, they are a signature together and without each one of them, so that sets meet there
whose difference is in that part. What is left are partitions of one shingle or none. n1 has a margin for those,
and a set that has no more of them than the margin leaves the signatures of their empty pairs out: a similar
set then still agrees with it in a partition that has shingles. Sets beyond the margin emit them all.

Similar sets share more signatures than one: each partition with at most one difference has one, and there are as
many of those as the margin and one more, less those of one shingle or none. Two sets that share fewer are no
candidates. A line or passage that very many documents have gives many pairs one signature by chance, through
which most of a large table would hang together, and few pairs several. Where more than PAIRED sets share a
signature their pairs aren't counted; all of them hang on the least.

Equal sets are one set from the start. Candidates that hang together
form groups, which are ordered by size, cut into blocks and verified by exact intersection, block against block,
leaving out blocks of too different sizes. A task finds a spanning forest of the links among its sets and emits
that alone, so neither candidates nor links are ever written as pairs of a whole group. The forests' connected
components are the classes. No link between different texts is lost, whatever the size of a group.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer
than `n` words has one shingle, all its words; repeated rows are linked; a null id is linked with nothing that
has none; a very long text is one set like others, cut into no windows; an empty table gives an empty result;
other columns are ignored by `join` and carried by `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, ship, spare
from .components import connected_components

BAND = 1.4
PARTS = 3
BLOCK = 512_000
BROADCAST_ROWS = 1_000_000
HOT_ROWS = 1 << 18
#: Up to so many sets that share a signature are counted as pairs.
PAIRED = 64
#: A set says in the low bits of its signatures how many of them a similar set shares at least, up to 8.
NEEDED = 8
#: Rows whose signatures are wanted are marked in so many bits where they are too many to be broadcast.
MARKS = 1 << 27
CHUNK = 4 << 20
_PLAIN = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in bytes(range(256)).lower())
_U = np.uint64


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _word_hashes(unique: pa.Array) -> np.ndarray:
    """64-bit hashes of different words, eight bytes at a time."""
    size = pc.binary_length(unique).to_numpy().astype(np.int64)
    h = _mix(size.astype(_U), 1)
    step = 0
    data = np.frombuffer(b"".join(x.as_buffer() for x in unique) + bytes(8), np.uint8)
    start = np.cumsum(size) - size
    live = np.arange(len(size))
    shifts = (np.arange(8) * 8).astype(_U)
    while len(live := live[size[live] > step]):
        at = start[live, None] + step + np.arange(8)
        inside = step + np.arange(8) < size[live, None]
        part = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(_U)
        h[live] = _mix(h[live] ^ (part << shifts).sum(axis=1, dtype=_U), 2)
        step += 8
    return h


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashed shingles of each text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CHUNK, side="right")))
        part = pa.concat_arrays([texts.slice(begin, end - begin)])
        _, offsets, data = part.buffers()
        plain = pa.StringArray.from_buffers(len(part), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_PLAIN)))
        split = pc.split_pattern(plain, " ")
        known = split.flatten().dictionary_encode()
        at, ends = known.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        there = (pc.binary_length(known.dictionary).to_numpy() > 0)[at]
        bounds = np.concatenate([[0], np.cumsum(there)])[ends - ends[0]].tolist()
        words = _word_hashes(known.dictionary)[at[there]]
        h = _mix(words[: max(0, len(words) - n + 1)], 3)
        for j in range(1, n):
            h = _mix(h ^ words[j : j + len(h)], 3 + j)
        for a, b in zip(bounds, bounds[1:]):  # noqa: B905
            if b - a >= n:
                yield np.unique(h[a : b - n + 1])
            elif b > a:
                x = _mix(words[a : a + 1], 100 + b - a)
                for w in words[a + 1 : b]:
                    x = _mix(x ^ w, 101)
                yield x
            else:
                yield words[:0]
        begin = end


@dataclass(frozen=True)
class Similarity:
    """Two sets link if num * |union| <= den * |intersection|."""

    num: int
    den: int

    def differences(self, smaller: int) -> int:
        """The most elements in which two linked sets can differ, the smaller of which has so many."""
        larger = smaller * self.den // self.num
        return (self.den - self.num) * (smaller + larger) // (self.den + self.num)

    def linked(self, size: int, sizes: np.ndarray, common: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (size + sizes - common)


@dataclass(frozen=True)
class Instance:
    number: int
    low: int
    high: int
    partitions: int
    margin: int


def instances(similarity: Similarity, size: int) -> list[Instance]:
    """Those that a set of this size belongs to: its band's, and the one before if it is near its lower end."""
    found, low, number = [], 1, 0
    while low <= size:
        end = max(low + 1, int(low * BAND))  # smaller sets of the instance are below this
        high = (end - 1) * similarity.den // similarity.num
        if low <= size <= max(high, end - 1):
            k = similarity.differences(end - 1)
            margin = 2 + k // 16
            found.append(Instance(number, low, high, k // 2 + 1 + margin, margin))
        low, number = end, number + 1
    return found


def signatures(s: np.ndarray, similarity: Similarity) -> np.ndarray:
    """The signatures of a set in all its instances."""
    return _signed(s, similarity)[0]


def _signed(s: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, int]:
    """The signatures of a set in all its instances, and how many of them any similar set shares at least."""
    found, needed = [], NEEDED
    for x in instances(similarity, len(s)):
        h = _mix(s, 200 + x.number)
        cell = (h >> _U(32)) % _U(x.partitions) * _U(PARTS) + (h & _U(0xFFFFFFFF)) % _U(PARTS)
        total, mixed = np.zeros(x.partitions * PARTS, _U), _mix(h, 7)
        count = np.bincount(cell.astype(np.int64), minlength=len(total)).reshape(-1, PARTS)
        np.add.at(total, cell.astype(np.int64), mixed)
        total = total.reshape(-1, PARTS)
        place = _mix(np.arange(x.partitions).astype(_U), 300 + x.number)
        none = np.stack([count[:, (o + 1) % PARTS] + count[:, (o + 2) % PARTS] == 0 for o in range(PARTS)])
        few = count.sum(axis=1) < 2
        bad = int(few.sum())
        all_of_them = bad > x.margin
        needed = min(needed, max(1, 1 + x.margin - bad))
        for o in range(PARTS):
            sig = _mix(_mix(total[:, (o + 1) % PARTS] ^ place, 400 + o) + total[:, (o + 2) % PARTS], 500)
            found.append(sig[~none[o] | few] if all_of_them else sig[~none[o]])
        at = (cell // _U(PARTS)).astype(np.int64)
        one_part = (count.max(axis=1) == count.sum(axis=1)) & (count.sum(axis=1) > 0)
        whole = total.sum(axis=1, dtype=_U)
        without = one_part[at] & ~few[at]
        rest = np.concatenate([whole[one_part] ^ place[one_part], whole[at[without]] - mixed[without] ^ place[at[without]]])
        found.append(_mix(_mix(rest, 410), 501))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, _U), needed


def forest(sets: list[np.ndarray], similarity: Similarity) -> np.ndarray:
    """For each set the least one that it hangs together with by links."""
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    if len(sets) < 2:
        return label
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(len(values), np.int64)
    for i in range(len(sets) - 1):
        open_ = np.flatnonzero((label[i + 1 :] != label[i]) & (similarity.num * size[i + 1 :] <= similarity.den * size[i]) & (similarity.num * size[i] <= similarity.den * size[i + 1 :])) + i + 1
        if not len(open_):
            continue
        own = flat[starts[i] : ends[i]]
        mark[own] = 1
        if len(open_) > 8:
            common = np.add.reduceat(mark[flat], starts)[open_]
        else:
            common = np.array([mark[flat[starts[j] : ends[j]]].sum() for j in open_])
        mark[own] = 0
        hit = open_[similarity.linked(size[i], size[open_], common)]
        if len(hit):
            together = np.unique(label[np.append(hit, i)])
            label[np.isin(label, together)] = together[0]
    return label


def _keys_of_documents(docs: DataFrame, n: int) -> DataFrame:
    """Per document the size of its set and two 64-bit keys that equal sets share."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = [], ([], [])
            for s in shingle_sets(b.column(2), n):
                sizes.append(len(s))
                for k, salt in zip(keys, (8, 9), strict=True):
                    k.append(_mix(s, salt).sum(dtype=_U) if len(s) else _U(0))
            key_columns = [pa.array(np.array(k, _U).view(np.int64)) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), *key_columns], ["doc_id", "row_key", "size", "k1", "k2"])

    return docs.mapInArrow(build, f"doc_id {id_type}, row_key bigint, size bigint, k1 bigint, k2 bigint")


def _marks(rids: DataFrame) -> np.ndarray:
    """A bit for the low bits of each rid. Its size is fixed: the more rids, the more others are taken for one."""
    place = F.col("rid").bitwiseAND(F.lit(MARKS - 1))
    rows = rids.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(rid & 63 AS int))").alias("bit"))
    rows = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MARKS / 64
    marks = np.zeros(max(1, MARKS >> 6), np.int64)
    marks[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return marks


def _signatures_of_documents(docs: DataFrame, n: int, similarity: Similarity, marks: np.ndarray | None = None, rows: int = 1 << 18) -> DataFrame:
    """A row for each signature of each document (row_key, t) that may be marked: rid, sig. The low bits of sig say how
    many a similar set shares at least, less one."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if marks is not None:
                rid = b.column(0).to_numpy()
                b = b.filter(pa.array(marks[(rid & MARKS - 1) >> 6] >> (rid & 63) & 1 == 1))  # noqa: PLW2901
            found, of, held = [], [], 0

            def part() -> pa.RecordBatch:
                at = np.repeat(np.array(of, np.int64), [len(x) for x in found])
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(found))], ["rid", "sig"])  # noqa: B023

            for i, s in enumerate(shingle_sets(b.column(1), n)):
                sig, needed = _signed(s, similarity)
                found.append((sig & ~_U(NEEDED - 1) | _U(needed - 1)).view(np.int64))
                of.append(i)
                held += len(found[-1])
                if held >= rows:
                    yield part()
                    found, of, held = [], [], 0
            if held:
                yield part()

    return docs.mapInArrow(sign, "rid bigint, sig bigint")


def _key() -> Column:
    return F.col("sig").bitwiseAND(F.lit(-NEEDED))


def _meetings(signed: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """What shares a signature, of rows (rid, sig, salt) that are dealt by key and salt and sorted: rid, anchor, n, needed, hot.
    Pairs have n = 1, more than PAIRED sets hang on the least with n = NEEDED, as do all with a salt, where hot is the
    key and the least set hangs on itself."""

    def pairs(key: np.ndarray, salt: np.ndarray, rid: np.ndarray, needed: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) | np.diff(salt, prepend=salt[:1]))
        size = np.diff(first, append=len(key))
        for m in np.unique(size[(size > 1) & (size <= PAIRED) & (salt[first] < 0)]).tolist():
            x, y = np.triu_indices(m, 1)
            starts = first[(size == m) & (salt[first] < 0)]
            step = max(1, rows // len(x))
            for at in range(0, len(starts), step):
                a, b = ((starts[at : at + step, None] + k).ravel() for k in (y, x))
                yield _met(rid[a], rid[b], np.ones(len(a), np.int64), np.maximum(needed[a], needed[b]), None)
        star = np.repeat((size > PAIRED) | (salt[first] >= 0), size)
        anchor, hot = np.repeat(rid[first], size), salt >= 0
        star &= hot | (rid != anchor)
        if star.any():
            all_ = np.full(int(star.sum()), NEEDED)
            yield _met(rid[star], anchor[star], all_, all_, pa.array(key[star], mask=~hot[star]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in range(3)])
            waiting += b.num_rows
            if waiting >= rows:  # the last group may go on
                rid, sig, salt = (np.concatenate(c) for c in zip(*held, strict=True))
                end = int(np.flatnonzero((sig & -NEEDED != sig[-1] & -NEEDED) | (salt != salt[-1])).max(initial=-1)) + 1
                yield from ready(rid[:end], sig[:end], salt[:end])
                held, waiting = [[rid[end:], sig[end:], salt[end:]]], 0
        if held:
            yield from ready(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def ready(rid: np.ndarray, sig: np.ndarray, salt: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rid):
            key = sig & -NEEDED
            new = np.append(True, (key[1:] != key[:-1]) | (rid[1:] != rid[:-1]) | (salt[1:] != salt[:-1]))
            yield from pairs(key[new], salt[new].astype(np.int64), rid[new], (sig[new] & NEEDED - 1) + 1)

    dealt = signed.repartition(_key(), "salt").sortWithinPartitions(_key(), "salt", "rid")
    return dealt.select("rid", "sig", "salt").mapInArrow(meet, "rid bigint, anchor bigint, n bigint, needed bigint, hot bigint")


def _met(rid: np.ndarray, anchor: np.ndarray, n: np.ndarray, needed: np.ndarray, hot: pa.Array | None) -> pa.RecordBatch:
    hot = pa.nulls(len(rid), pa.int64()) if hot is None else hot
    return pa.RecordBatch.from_arrays([*map(pa.array, (rid, anchor, n, needed)), hot], ["rid", "anchor", "n", "needed", "hot"])


def join(docs: DataFrame, n: int = 5, similarity: Similarity = Similarity(80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id that links lead to, its own included)."""
    return _classes(docs, n, similarity, id_col, text).select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def _classes(docs: DataFrame, n: int, similarity: Similarity, id_col: str, text: str) -> DataFrame:
    """Per document: doc_id, row_key, size, and of its class the least id and the row of it (least, keeper), which
    are null for a null id and for an empty set. Rows go by their id and text, as several texts can share an id."""
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text)).alias("row_key"), F.col(text).alias("t"))
    sets = materialize(_keys_of_documents(d, n), "jaccard-sets")
    d = d.where(F.col("doc_id").isNotNull()).select("row_key", "t")
    grouped = sets.where("size > 0 AND doc_id IS NOT NULL")
    if _repeated(grouped):
        d = d.dropDuplicates(["row_key"])
    representative = grouped.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row_key")).alias("x"), F.max("size").alias("size"))
    representative = materialize(representative.select("k1", "k2", "x", F.col("x.row_key").alias("rid"), "size"), "jaccard-signed")
    # of equal sets one is signed; nothing but signatures is shuffled
    wanted, marks = representative.select("rid"), None
    if representative.count() <= BROADCAST_ROWS:
        some = d.join(F.broadcast(wanted), d.row_key == wanted.rid, "left_semi")
    else:
        some, marks = d, _marks(wanted)
    signed = _signatures_of_documents(some, n, similarity, marks)
    # what has a hot signature is dealt over salts and hangs on the least one of its salt first
    hot = _hot_signatures(d, representative.count(), n, similarity)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if hot:
        listed = F.broadcast(spark.createDataFrame([(x & -NEEDED,) for x in hot], "hot bigint").distinct())  # bounded, see there
        signed = signed.join(listed, _key() == listed.hot, "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod("rid", F.lit(salts))).otherwise(-1).cast("int"))
    else:
        signed = signed.withColumn("salt", F.lit(-1))
    found = _meetings(signed)
    if hot:
        found = materialize(found, "jaccard-candidates")
        least = found.where("hot IS NOT NULL").groupBy("hot").agg(F.min("anchor").alias("least"))
        across = found.where("hot IS NOT NULL").select("hot", F.col("anchor").alias("rid")).distinct().join(F.broadcast(least), "hot")
        across = across.select("rid", F.col("least").alias("anchor"), F.lit(NEEDED).alias("n"), F.lit(NEEDED).alias("needed"))
        found = found.drop("hot").unionByName(across)
    candidates = found.where("rid <> anchor").groupBy("rid", "anchor").agg(F.sum("n").alias("n"), F.max("needed").alias("needed")).where("n >= needed")
    groups = materialize(connected_components(candidates, "rid", "anchor"), "jaccard-groups")
    links = _verify(d, representative.select("rid", "size"), groups, n, similarity)
    classes = materialize(connected_components(links, "rid", "root"), "jaccard-linked")
    linked = classes.join(representative.select("rid", "x"), classes.node == F.col("rid"))
    best = linked.groupBy("component").agg(F.min("x").alias("best"))
    best = linked.join(best, "component").select("rid", "best")
    placed = representative.join(best, "rid", "left").select("k1", "k2", F.coalesce("best", "x").alias("best"))
    grouping = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    return sets.join(placed, ["k1", "k2"], "left").select(
        "doc_id", "row_key", "size", F.when(grouping, F.col("best.doc_id")).alias("least"), F.when(grouping, F.col("best.row_key")).alias("keeper")
    )


def _hot_signatures(d: DataFrame, sets: int, n: int, similarity: Similarity) -> list[int]:
    """Signatures that so many sets share that one task shouldn't order them, as counted over every 64th set (by the hash
    that its key is). This steers how rows are dealt and no result. Each has more than 1 / (4 x partitions) of the sets, which have some
    hundred signatures each, so what comes here is bounded by the partitions."""
    if sets <= HOT_ROWS:
        return []
    least = max(HOT_ROWS, sets // (4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = _signatures_of_documents(d.where(F.pmod("row_key", F.lit(64)) == 0), n, similarity)
    return [r.sig for r in some.groupBy(_key().alias("sig")).count().where(F.col("count") * 64 > least).select("sig").collect()]


def _weight() -> Column:
    return F.greatest("size", F.lit(1000))


def _broadcast_if_few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _blocks(sizes: DataFrame) -> DataFrame:
    """Deals the sets (component, rid, size) of each component into blocks of alike sizes. Sizes are laid end to end by
    their weights; a set's place within its size goes by its hash, so that no task orders or numbers sets."""
    total = sizes.groupBy("component").agg(F.sum(_weight()).alias("total")).where(F.col("total") > BLOCK)
    sizes = sizes.join(_broadcast_if_few(materialize(total, "jaccard-large")), "component", "left")  # not dealt by component
    large = sizes.where("total IS NOT NULL")
    earlier = Window.partitionBy("component").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    base = large.groupBy("component", "size").agg(F.sum(_weight()).alias("w"))  # a row for each size, however many sets
    base = base.select("component", "size", "w", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"))
    within = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) / float(1 << 30)
    placed = large.join(_broadcast_if_few(materialize(base, "jaccard-base")), ["component", "size"])
    block = F.floor((F.col("base") + within * F.col("w")) / BLOCK).cast("int")
    few = sizes.where("total IS NULL").select("component", "rid", "size", F.lit(0).alias("block"))
    return few.unionByName(placed.select("component", "rid", "size", block.alias("block")))


def _verify(d: DataFrame, sizes: DataFrame, groups: DataFrame, n: int, similarity: Similarity) -> DataFrame:
    """Links among the candidates, a spanning forest for each pair of blocks: (rid, root)."""
    sizes = sizes.join(groups, sizes.rid == groups.node).select("component", "rid", "size")
    members = materialize(_blocks(sizes), "jaccard-members")
    weight = _weight()
    blocks = members.groupBy("component", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum(weight).alias("w"))
    total = blocks.groupBy("component").agg(F.count(F.lit(1)).alias("n_blocks"))
    small = members.join(total.where("n_blocks = 1"), "component")
    tasks = max(1, -(-(small.agg(F.sum(weight)).first()[0] or 0) // (4 * BLOCK)), min(members.count() // 64, 2 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    few = small.select("component", "rid", F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"), F.lit(-1).alias("x"), F.lit(-1).alias("y"))
    x, y = blocks.join(total.where("n_blocks > 1"), "component").alias("x"), blocks.alias("y")
    near = F.col("y.least") * similarity.num <= F.col("x.most") * similarity.den
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & near).select(
        F.col("x.component").alias("component"), F.col("x.block").alias("x"), F.col("y.block").alias("y")
    )
    dealt = pairs.select("component", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    many = members.join(dealt, ["component", "block"]).select("component", "rid", F.col("component").cast("bigint").alias("task"), "x", "y")
    wanted = materialize(few.unionByName(many), "jaccard-tasks")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = d.join(wanted, d.row_key == wanted.rid).select("task", "x", "y", "component", "rid", "t")

    def link(table: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if table.num_rows:
            table = table.sort_by([("component", "ascending"), ("rid", "ascending")])
            found = list(shingle_sets(table["t"].combine_chunks(), n))
            rid, component = table["rid"].to_pylist(), table["component"].to_numpy()
            cuts = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(rid)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                for i, r in enumerate(forest(found[a:b], similarity).tolist()):
                    if r != i:
                        out[0].append(rid[a + i])
                        out[1].append(rid[a + r])
        kind = table.schema.field("rid").type
        return pa.table([pa.array(out[0], kind), pa.array(out[1], kind)], ["rid", "root"])

    return rows.groupBy("task", "x", "y").applyInArrow(link, "rid bigint, root bigint")


def _repeated(rows: DataFrame) -> bool:
    """Does any id stand in more than one row with the same text?"""
    return bool(rows.groupBy("row_key").count().where("count > 1").limit(1).count())


def one_of_each(docs: DataFrame, n: int = 5, similarity: Similarity = Similarity(80, 100), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without those that link to one of a smaller id (or, under the same id, to the row
    that stands for it), and repeated rows once. Documents of a null id all stay."""
    classes = materialize(_classes(docs, n, similarity, id_col, text), "jaccard-classes")
    key = spare(docs, "row_key")
    kept = docs.withColumn(key, row_key(F.col(id_col), F.col(text)))
    gone_key, gone_id = spare(kept, "gone_key"), spare(kept, "gone_id")
    gone = classes.where("row_key <> keeper").select(F.col("row_key").alias(gone_key), F.col("doc_id").alias(gone_id)).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = kept.join(gone, (kept[key] == gone[gone_key]) & (kept[id_col] == gone[gone_id]), "left_anti")
    if _repeated(classes.where(F.col("doc_id").isNotNull())):
        named = F.col(id_col).isNotNull()
        kept = kept.where(named).dropDuplicates([id_col, key]).unionByName(kept.where(~named))
    return kept.drop(key)
