"""Token counts by rank-synchronous array merging.

Batches of pre-tokens are ragged numpy arrays: one flat array of symbols and the start of each sequence. In each
round every sequence applies its lowest-rank pair at all its places at once (in a run of one symbol, at every
other place from the left); sequences without a pair that the vocabulary knows leave the batch with their number
of symbols. As a merged symbol only takes part in pairs of higher ranks than its own, this gives what merging one
pair at a time gives. A long sequence is an array of its own with links to the next and the previous symbol; the
places of its pairs are kept by rank, and a round touches only the places of the lowest one.

Vocabularies are byte-level BPE files of the tokenizers library. A special string inside a text is one token, as
in the library's default. Counts are remembered by piece, see tokens.py.

Defined cases: a null text is empty: 0 bytes, 0 tokens; a very long text, or word, is counted whole; repeated rows each get their count; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import PieceMemory, byte_characters, kind_of

# Fixed value: how byte-level BPE with 50,257 ids cuts texts.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
LONG = 2048


class RankMerger:
    def __init__(self, config: dict):
        vocab = config["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in config["model"]["merges"]]
        self.n = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.symbols = np.array([vocab[c] for c in byte_characters()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or NONE."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def long_count(self, sequence: bytes) -> int:
        """The number of symbols that remain of one long sequence."""
        symbol = self.symbols[np.frombuffer(sequence, np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank_of(symbol[at], symbol[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, some in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(some)

        add(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            at = at[self.rank_of(symbol[at], symbol[after[at]]) == r]
            # in a run of places that share symbols every other one is merged
            joins = np.concatenate([[False], after[at[:-1]] == at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(joins, 0, place))) % 2 == 0]
            gone = after[at]
            symbol[at] = self.merged[r]
            alive[gone] = False
            after[at] = after[gone]
            follow = at[after[at] < n]
            before[after[follow]] = follow
            lead = before[at]
            add(np.unique(np.concatenate([follow, lead[lead >= 0]])))
        return int(alive.sum())

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """The number of symbols that remain of each sequence, none of which is empty."""
        result = np.zeros(len(sequences), np.int64)
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        for i in np.flatnonzero(sizes > LONG).tolist():
            result[i] = self.long_count(sequences[i])
        who = np.flatnonzero(sizes <= LONG)
        sizes = sizes[who]
        flat = self.symbols[np.frombuffer(b"".join(sequences[i] for i in who.tolist()), np.uint8)]
        while len(who):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of = np.repeat(np.arange(len(who)), sizes)
            rank = np.full(len(flat), NONE)
            rank[:-1] = np.where(of[:-1] == of[1:], self.rank_of(flat[:-1], flat[1:]), NONE)
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            result[who[done]] = sizes[done]
            take = (rank == lowest[of]) & ~done[of]
            # neighbours that both could merge share a symbol: every other one does
            run_start = take & ~np.concatenate([[False], take[:-1]])
            place = np.arange(len(take))
            take &= (place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0
            flat = np.where(take, self.merged[np.where(take, rank, 0)], flat)
            gone = np.concatenate([[False], take[:-1]])
            sizes = (sizes - np.add.reduceat(gone, starts))[~done]
            flat, who = flat[~gone & ~done[of]], who[~done]
        return result


_counters: dict[str, PieceMemory] = {}


def counter(path: str, chunk: int = 1 << 16) -> PieceMemory:
    if path not in _counters:
        import regex

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if kind_of(config) != "keep" or config["model"].get("dropout") or config["model"].get("ignore_merges"):
            raise ValueError("not a byte-level BPE vocabulary of the known kind")
        merger, cut = RankMerger(config), regex.compile(PRE_TOKEN)
        added = sorted((x["content"] for x in config["added_tokens"]), key=len, reverse=True)
        special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

        def look_up(pieces: list[str]) -> list[int]:
            counts = np.zeros(len(pieces), np.int64)
            index: dict[str, int] = {}
            where, which = [], []
            for i, piece in enumerate(pieces):
                parts = special.split(piece) if special and special.search(piece) else [piece]
                counts[i] += len(parts) // 2
                for part in parts[::2]:
                    for x in cut.findall(part):
                        where.append(i)
                        which.append(index.setdefault(x, len(index)))
            unique = [x.encode() for x in index]
            n = np.concatenate([np.zeros(0, np.int64), *(merger.counts(unique[k : k + chunk]) for k in range(0, len(unique), chunk))])
            np.add.at(counts, np.array(where, np.int64), n[np.array(which, np.int64)])
            return counts.tolist()

        _counters[path] = PieceMemory("keep", look_up)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n = memory.sums(texts)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = d.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
