"""Hard negatives, near-duplicate vectors and token alignment against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrill.llm import alignment, hard_negatives, vector_dedup
from evidrill.llm.queries import tokenizer_path

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v string, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], VECTORS)


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


def mined(rows, every, k=5):
    best = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and usable(v):
            key = (str(lab), [float(np.float32(c)) for c in v])
            best[i] = min(best.get(i, key), key)
    x = {i: ([int(np.floor(256 * c)) for c in v], lab) for i, (lab, v) in best.items()}
    out = []
    for a in x:
        if a % every:
            continue
        score = {j: sum(p * q for p, q in zip(x[a][0], x[j][0], strict=True)) for j in x if j != a}
        first = sorted((-s, j) for j, s in score.items() if x[j][1] == x[a][1])[:5]
        for s, p in first:
            found = sorted((-t, j) for j, t in score.items() if x[j][1] != x[a][1] and 80 * -s <= 100 * t <= 100 * -s)[:k]
            out += [(a, p, r, j, -s, -t) for r, (t, j) in enumerate(found, 1)]
    return sorted(out)


def clouds(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    x = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))
    return [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("spread", "dims"), [(0.05, 12), (1.0, 8), (0.3, 2)])
def test_hard_negatives_match_a_plain_version(spark, spread, dims):
    rows = clouds(3, 900, dims, spread)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]  # copies: ties by id
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"), cells=40, fit_rows=200, share_rows=20)
    assert sorted(map(tuple, got.collect())) == mined(rows, 20)


def test_bounds_exclude_what_is_far(spark, monkeypatch):
    """Among tight clouds few rows are scored, and none that was needed is left out."""
    rows, seen = clouds(5, 4000, 16, 0.02), []
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float))
    norms = np.sqrt((x * x).sum(axis=1))
    model = hard_negatives.fit(x[:500], 16, 8)
    block = hard_negatives.Rows(np.arange(4000), np.array([str(r[2]) for r in rows], object), x, norms, model.angles(x, norms).astype(float))
    plain = hard_negatives.scores
    monkeypatch.setattr(hard_negatives, "scores", lambda y, a: seen.append(len(y)) or plain(y, a))
    for i in range(0, 4000, 400):
        s, _ = block.positives(i, block.labels[i], x[i], norms[i], block.angles[i], 5, -np.inf)
        every = sorted((x[(block.labels == block.labels[i]) & (block.ids != i)] @ x[i]).tolist())[-5:]
        assert s.tolist() == every[::-1]
        low, high = block.bounds(block.angles[i], norms[i])
        assert ((low <= x @ x[i]) & (x @ x[i] <= high)).all()
    assert sum(seen) < 0.3 * 10 * 4000


def test_hard_negative_edges(spark):
    big = 3.0e38
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
            (7, [0.0, 0.0], 1), (8, [-1.0, -0.5], 1), (9, [1.0, 0.4], None), (None, [1.0, 0.4], 1), (10, [1.0, 0.4], 3), (20, [0.0, 0.0], 2), (2, [0.9, 0.5], 9)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == mined(rows, 10)
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") == 0, F.col("label")).count() == 0
    odd = hard_negatives.mine(vectors(spark, [*rows, (11, [1.0, 2.0, 3.0], 1)]), F.col("vec_id") % 10 == 0, F.col("label"))
    assert sorted(map(tuple, odd.collect())) == mined(rows, 10)
    wide = [(0, [1e12, 3e12], 1), (1, [2e12, 1e12], 1), (2, [2e12 + 1e6, 1e12], 2), (3, [1e12, 1e12], 2)]
    got = hard_negatives.mine(vectors(spark, wide), F.col("vec_id") == 0, F.col("label")).collect()
    assert [(r[1], r[3]) for r in got] == [(r[1], r[3]) for r in mined(wide, 10)]
    assert hard_negatives.mine(vectors(spark, [(0, [big, big], 1), (1, [big, 0.0], 1), (2, [big, 1.0], 2)]), F.col("vec_id") == 0, F.col("label")).count() >= 0


def linked(rows, cosine=0.93):
    nodes = []
    for i, v, lab in rows:
        if i is not None and lab is not None and usable(v) and any(v):
            node = (i, lab, tuple(float(np.float32(c)) for c in v))
            if node not in nodes:
                nodes.append(node)
    x = np.array([n[2] for n in nodes])
    norm = np.sqrt((x * x).sum(axis=1))
    c = (x @ x.T) / np.outer(norm, norm)
    near = (c >= cosine) & np.array([[a[1] == b[1] for b in nodes] for a in nodes])
    np.fill_diagonal(near, False)
    least = np.array([n[0] for n in nodes])
    while True:
        new = np.where(near, least[None], least[:, None]).min(axis=1)
        if (new == least).all():
            break
        least = new
    of = dict(zip(nodes, zip(near.sum(axis=1).tolist(), least.tolist(), strict=True), strict=True))
    out = []
    for i, v, lab in rows:
        n, comp = of.get((i, lab, tuple(float(np.float32(c)) for c in v) if usable(v) else None), (0, i))
        out.append((i, n, comp, i == comp if i is not None else True))
    return sorted(out, key=str)


@pytest.mark.parametrize(("spread", "cell_rows", "tile_rows"), [(0.3, 1 << 15, 4096), (0.3, 40, 16), (0.15, 100, 30), (0.8, 25, 1000)])
def test_classes_match_a_plain_version(spark, spread, cell_rows, tile_rows):
    rows = clouds(7, 700, 12, spread)
    rows += [(1000 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(50)] + [(i, v, lab) for i, v, lab in rows[:3]]
    got = vector_dedup.classes(vectors(spark, rows), cell_rows=cell_rows, tile_rows=tile_rows, fit_rows=300)
    assert sorted(map(tuple, got.collect()), key=str) == linked(rows)


def test_classes_of_low_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [*rng.normal(size=2).tolist(), *[0.0] * 10], 1) for i in range(300)]
    assert sorted(map(tuple, vector_dedup.classes(vectors(spark, rows), cell_rows=50).collect()), key=str) == linked(rows)


def test_class_edges(spark):
    rows = [(5, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], 2), (6, [0.0, 0.0], 1), (7, None, 1), (8, [None, 1.0], 1), (9, [float("nan"), 0.0], 1),
            (None, [1.0, 0.0], 1), (10, [1.0, 0.0], None), (11, [5.0, 0.0], 1), (12, [-1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    assert sorted(map(tuple, vector_dedup.classes(vectors(spark, rows)).collect()), key=str) == linked(rows)
    odd = [*rows, (13, [1.0, 0.0, 0.0], 1)]
    assert sorted(map(tuple, vector_dedup.classes(vectors(spark, odd)).collect()), key=str) == sorted([*linked(rows), (13, 0, 13, True)], key=str)
    assert vector_dedup.classes(vectors(spark, [])).count() == 0
    assert vector_dedup.classes(vectors(spark, [(1, None, 1)])).collect()[0].kept


def test_cuts_are_the_shared_ends():
    rng = np.random.default_rng(0)
    ends_a, ends_b, first, last, base = [], [], [], [], 0
    for n in [1, 2, 3, 10, 500, 3000]:
        for share in (0.02, 0.3, 0.9):
            a = np.flatnonzero(rng.random(n) < share) + 1
            b = np.flatnonzero(rng.random(n) < share) + 1
            a, b = np.union1d(a, [n]), np.union1d(b, [n])
            first.append(sum(map(len, ends_a)))
            ends_a.append(a + base)
            ends_b.append(b + base)
            last.append(sum(map(len, ends_a)) - 1)
            base += n
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    assert (alignment.shared_cuts(a, np.array(first), np.array(last), b) == np.isin(a, b)).all()


TEXTS = [
    "The quick brown fox", "", None, " ", "  two  spaces ", "tab\there", "line\nfeed\n\nmore \n x", "\n", "\nstarts", "ends\n", "naïve façade – 東京 😀", "x▁y", "<|endoftext|> and <s> </s>", "a" * 3000,
    "mixed\r\nends and　wide", "isn't it's we'll", "antidisestablishmentarianism 1234567890", "zero\x00byte", "The quick brown fox", " sep", "word " * 4000, "é combining",
]


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    byte = {c: bytes([i]) for i, c in enumerate(alignment.byte_characters())}
    out, links = [], []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [b"".join(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
            groups.append(f"{','.join(map(str, ids_a[i:p]))}|{','.join(map(str, ids_b[j:q]))}")
            i, j = p, q
        pairs, j = [], 0
        for i, (x, e) in enumerate(zip(ids_a, ends_a, strict=True)):
            s = e - len(bytes_a[i])
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(ids_b) and ends_b[k] - len(bytes_b[k]) < e:
                pairs.append((x, ids_b[k]))
                k += 1
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(pairs)
    count = Counter(p for x in links for p in x)
    most = {}
    for (_, q), n in count.items():
        most[q] = max(n, most.get(q, 0))
    return [(n, m, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), sha) for (n, m, g, sha), x in zip(out, links, strict=True)]


@pytest.mark.parametrize("frequent", [1 << 20, 300, 1])
def test_alignment_matches_a_plain_version(spark, frequent):
    rows = [(i % 20 or None, t, "mine", "mine") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, t string, uid string").repartition(3)
    got = alignment.align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), frequent=frequent)
    want = [(r[0], *w) for r, w in zip(rows, plain_alignment(TEXTS), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert alignment.align_documents(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_alignment_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, plain_alignment(list(texts.values())), strict=True))
    got = alignment.align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
