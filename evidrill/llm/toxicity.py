"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first bytes (4, 5 and 6 of them), so
that forms of one stem share a part. Filters of widths 1, 2 and 3 run over the words of a whole text, each is
rectified and pooled to its maximum, and a logistic layer weighs the maxima. Buckets that no training text holds
stay at zero. Thresholds are set for each language on rows kept from training; the language is guessed from the
text's commonest words, never read from a column, and the threshold becomes the score 0.5.

Labelled rows are the only thing that is sampled: at most `rows` of each class, by a hash of their ids.

Defined cases: a null or empty text has no words and gets the score of no evidence; a label that is null or whose
document is missing is left out; a document with several labels has the highest, and of several texts of an id the least trains;
repeated rows each get their score; a very long text is scored whole; a score of exactly 0.5 is toxic; without any
usable label every score is 0; an empty table gives an empty result; other columns, whatever their names, are ignored by
`score` and carried by `without_toxic`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
BUCKETS = 1 << 16
CHUNK = 2 << 20

# Common words that tell languages apart.
COMMON = {
    "en": "the of and to in is was for with are that he as on be at by this from".split(),
    "fr": "le la les des et du un une que qui dans est pour au sur pas avec ne ce il".split(),
    "de": "der die das und den von zu mit sich des auf ist im nicht ein eine dem es".split(),
    "es": "el los las del y en por con una su para lo se no al como que un os de".split(),
}
LANGUAGES = (*COMMON, "other")

#: Lower-cases A-Z and makes all other ASCII but letters and digits spaces; bytes beyond ASCII stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each, by wrapping prefix sums of a polynomial."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.full(len(data) + 1, base))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    back = np.cumprod(np.full(len(data) + 1, inverse))
    h = (total[ends] - total[starts]) * back[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


@dataclass
class Words:
    """Words of some texts: each one's place among the different ones, where texts start, the buckets of the
    different words, and which common words of each language they are."""

    at: np.ndarray
    bounds: np.ndarray
    buckets: np.ndarray
    common: np.ndarray


def words_of(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts])  # without an offset into larger buffers
    _, offsets, data = texts.buffers()
    plain = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_PLAIN)))
    split = pc.split_pattern(plain, " ")
    known = split.flatten().dictionary_encode()
    at, ends = known.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    unique = known.dictionary
    size = pc.binary_length(unique).to_numpy()
    there = (size > 0)[at]
    bounds = np.concatenate([[0], np.cumsum(there)])[ends]
    raw = np.frombuffer(b"".join(x.as_buffer() for x in unique), np.uint8)
    stop = np.cumsum(size).astype(np.int64)
    start = stop - size
    buckets = [_hash(raw, start, stop) % np.uint64(BUCKETS)]
    for n in PREFIXES:  # a shorter word's prefix is itself, under another hash
        h = _hash(raw, start, np.minimum(start + n, stop)) * np.uint64(2 * n + 1)
        buckets.append((h >> np.uint64(17)) % np.uint64(BUCKETS))
    common = np.stack([pc.is_in(unique, value_set=pa.array(w)).to_numpy(zero_copy_only=False) for w in COMMON.values()])
    return Words(at[there], bounds, np.stack(buckets, 1).astype(np.int64), common)


def languages(w: Words) -> np.ndarray:
    """The language that each text's common words point to, as a place in LANGUAGES."""
    hits = np.stack([np.diff(np.concatenate([[0], np.cumsum(c[w.at])])[w.bounds]) for c in w.common])
    return np.where(hits.max(axis=0) > 0, hits.argmax(axis=0), len(COMMON))


@dataclass
class Model:
    tables: np.ndarray  # for the word and each prefix: buckets x dimensions
    filters: list[np.ndarray]  # for each width: width x dimensions x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(LANGUAGES)))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return sum(t[buckets[:, i]] for i, t in enumerate(self.tables))

    def pooled(self, w: Words, where: bool = False):
        """The maximum of each filter over each text, and where it was found."""
        k = self.filters[0].shape[2]
        v = self.embed(w.buckets)
        n, texts = len(w.at), len(w.bounds) - 1
        full = np.flatnonzero(np.diff(w.bounds))
        pooled = np.zeros((texts, k * len(WIDTHS)), np.float32)
        place = np.zeros(pooled.shape, np.int64)
        last = np.zeros(n, np.int64)  # words of the same text that follow
        last[:] = np.repeat(w.bounds[1:], np.diff(w.bounds)) - 1 - np.arange(n)
        for i, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            s = np.zeros((n, k), np.float32)
            for j in range(width):
                part = (v @ f[j])[w.at[j:]]
                if j:
                    part[last[: n - j] < j] = 0
                s[: n - j] += part
            cols = slice(i * k, (i + 1) * k)
            if len(full):
                best = np.maximum.reduceat(s, w.bounds[full], axis=0)
                pooled[full, cols] = best
                if where:
                    for t, m in zip(full.tolist(), best, strict=True):
                        a, b = w.bounds[t], w.bounds[t + 1]
                        place[t, cols] = a + (s[a:b] == m).argmax(axis=0)
        pooled = np.maximum(pooled + self.bias, 0)
        return (pooled, place, v) if where else pooled

    def logits(self, w: Words) -> np.ndarray:
        return self.pooled(w) @ self.out + self.out_bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        found, start = [np.zeros(0)], 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + CHUNK, side="right")))
            w = words_of(texts.slice(start, end - start))
            g = languages(w)
            z = (self.logits(w) - self.threshold[g]) * self.scale[g]
            found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            start = end
        return np.concatenate(found)


def train(texts: pa.Array, labels: np.ndarray, dims: int = 8, k: int = 6, epochs: int = 6, batch: int = 32, rate: float = 0.1, seed: int = 3) -> Model:
    """Adagrad on the logistic loss, classes weighted alike; a fifth of the rows sets the thresholds."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    tables = np.zeros((1 + len(PREFIXES), BUCKETS, dims), np.float32)
    filters = [rng.normal(0, 0.3, (w, dims, k)).astype(np.float32) for w in WIDTHS]
    model = Model(tables, filters, np.zeros(k * len(WIDTHS), np.float32), rng.normal(0, 0.3, k * len(WIDTHS)), -1.0)
    order = rng.permutation(len(y))
    kept, held = order[len(y) // 5 :], order[: len(y) // 5]
    if not len(y) or len(set(y[kept].tolist())) < 2:
        model.out_bias, model.out = -30.0, np.zeros_like(model.out)
        return model
    groups = [words_of(texts.take(pa.array(kept[i : i + batch]))) for i in range(0, len(kept), batch)]
    truth = [y[kept[i : i + batch]] for i in range(0, len(kept), batch)]
    # the first dimension starts from how much more of the toxic texts hold a bucket, the others near zero
    seen = np.zeros((2, 1 + len(PREFIXES), BUCKETS))
    for w, t in zip(groups, truth, strict=True):
        for d in range(len(t)):
            some = w.buckets[np.unique(w.at[w.bounds[d] : w.bounds[d + 1]])]
            for i in range(some.shape[1]):
                seen[int(t[d]), i, np.unique(some[:, i])] += 1
    n1, n0 = y[kept].sum(), (1 - y[kept]).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    support = seen.sum(0)
    tables[:, :, 0] = np.where(support > 0, odds * support / (support + 10) / 4, 0)
    tables[:, :, 1:] = np.where(support[..., None] > 0, rng.normal(0, 0.05, (*support.shape, dims - 1)), 0)
    for f in filters:
        f[0, 0, : k // 2] = np.abs(f[0, 0, : k // 2]) + 0.5
    model.out[:] = np.tile(np.r_[np.full(k // 2, 0.5), np.full(k - k // 2, 0.1)], len(WIDTHS))
    weight = {1.0: len(kept) / 2 / n1, 0.0: len(kept) / 2 / n0}
    past = {"t": np.full(tables.shape, 1e-2, np.float32), "f": [np.full(f.shape, 1e-2) for f in filters], "b": np.full(model.bias.shape, 1e-2), "o": np.full(model.out.shape, 1e-2), "c": 1e-2}
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            w, t = groups[g], truth[g]
            pooled, place, v = model.pooled(w, where=True)
            z = pooled @ model.out + model.out_bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * np.array([weight[x] for x in t]) / len(t)
            d_out, d_c = pooled.T @ err + 1e-4 * model.out, err.sum()
            d_pool = (err[:, None] * model.out[None]) * (pooled > 0)
            d_pool[np.diff(w.bounds) == 0] = 0
            d_bias = d_pool.sum(0)
            for i, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                gr = d_pool[:, i * k : (i + 1) * k]
                rows, cols = np.nonzero(gr)
                if not len(rows):
                    continue
                d_f = np.zeros(f.shape)
                for j in range(width):
                    p = place[rows, i * k + cols] + j
                    ok = p < w.bounds[rows + 1]
                    u, value = w.at[p[ok]], gr[rows[ok], cols[ok]]
                    np.add.at(d_f[j].T, cols[ok], value[:, None] * v[u])
                    d_v = (value[:, None] * f[j][:, cols[ok]].T).astype(np.float32)
                    for q in range(len(tables)):
                        bucket, of = np.unique(w.buckets[u, q], return_inverse=True)
                        d = np.zeros((len(bucket), dims), np.float32)
                        np.add.at(d, of, d_v)
                        past["t"][q, bucket] += d * d
                        tables[q, bucket] -= rate * d / np.sqrt(past["t"][q, bucket])
                past["f"][i] += d_f * d_f
                f -= (rate * d_f / np.sqrt(past["f"][i])).astype(np.float32)
            past["b"] += d_bias * d_bias
            past["o"] += d_out * d_out
            past["c"] += d_c * d_c
            model.bias -= (rate * d_bias / np.sqrt(past["b"])).astype(np.float32)
            model.out -= rate * d_out / np.sqrt(past["o"])
            model.out_bias -= float(rate * d_c / np.sqrt(past["c"]))
    calibrate(model, texts.take(pa.array(held)), y[held])
    return model


def calibrate(model: Model, texts: pa.Array, y: np.ndarray) -> None:
    """For each language the threshold, in the middle of the widest gap among those of highest balanced accuracy,
    and a scale by the spread of the logits; a language with few rows takes what all rows give."""
    w = words_of(texts)
    z, g = model.logits(w), languages(w)

    def best(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        s = np.unique(z)
        cuts = (s[:-1] + s[1:]) / 2
        acc = np.array([(y[z >= c].sum() / y.sum()) + ((1 - y)[z < c].sum() / (1 - y).sum()) for c in cuts])
        at = np.flatnonzero(acc >= acc.max() - 1e-9)
        c = cuts[at[np.argmax((s[1:] - s[:-1])[at])]]
        return float(c), float(3 / max(1e-3, np.median(np.abs(z - c))))

    enough = lambda m: min(y[m].sum(), (1 - y[m]).sum()) >= 5 and len(np.unique(z[m])) > 2
    every = np.ones(len(y), bool)
    common = best(z, y) if enough(every) else (0.0, 1.0)
    for i in range(len(LANGUAGES)):
        model.threshold[i], model.scale[i] = best(z[g == i], y[g == i]) if enough(g == i) else common


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 4000) -> Model:
    """Train on at most `rows` labelled documents of each class, for which `usable` (over labels) holds."""
    known = labels.where(usable & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("_label"))
    some = known.where("_label = 1").orderBy(F.xxhash64(id_col), id_col).limit(rows).unionByName(
        known.where("_label = 0").orderBy(F.xxhash64(id_col), id_col).limit(rows)
    )
    texts = docs.select(id_col, F.col(text).alias("_text")).join(F.broadcast(some), id_col)  # 2 x rows at most
    picked = texts.groupBy(id_col).agg(F.min("_text").alias("_text"), F.max("_label").cast("int").alias("_label"))
    picked = picked.repartition(1).sortWithinPartitions(F.xxhash64(id_col), id_col).select("_text", "_label")
    ship(docs.sparkSession)
    found = picked.mapInArrow(_trained, "model binary").collect()
    return pickle.loads(found[0].model) if found else train(pa.array([], pa.string()), np.zeros(0))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all batches. It is trained in a task, as the driver hasn't the memory for the texts and their words."""
    rows = list(batches)
    if rows:
        t = pa.Table.from_batches(rows)
        model = train(t["_text"].cast(pa.string()).combine_chunks(), t["_label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _scores(batch: pa.RecordBatch, text: str, model: Model) -> np.ndarray:
    return model.scores(batch.column(batch.schema.get_field_index(text)).cast(pa.string()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, score, predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b, "t", shared.value))], ["doc_id", "score"])

    scored = d.mapInArrow(of, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents, all columns, that aren't predicted to be toxic."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b, text, shared.value) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
