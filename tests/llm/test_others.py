"""Neighbours, chat formatting, the pipeline, and what the registered queries promise."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidrill.llm import chat_format, components, neighbours, queries
from evidrill.llm.components import connected_components


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, rb string, code string")


def brute(rows, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    return {i: sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in x if j != i)[:k] for i in x}


def test_neighbours_reach_nearly_all(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + rng.normal(size=32) * (0.1 if i % 3 else 1.0)).tolist(), 0, "", "") for i in range(3000)]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    want = brute(rows, 10)
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        hits += len({r.vec_id for r in mine} & {j for _, j in want[q]})
    assert hits >= 0.95 * 300


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (2, [0.0, 1.0], 1, "", ""), (3, None, 1, "", ""), (4, [0.0, 0.0], 1, "", ""), (5, [None, 1.0], 1, "", ""),
            (6, [float("nan"), 1.0], 1, "", ""), (7, [1.0, 2.0, 3.0], 1, "", ""), (8, [1.0, 0.0], 1, "", ""), (100, [float("inf"), 0.0], 1, "", "")]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") % 2 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0) == [(0, 1, 1), (0, 2, 8), (0, 3, 2)]
    assert {r.query_id for r in got} == {0, 2, 8}
    assert neighbours.search(vectors(spark, []), F.col("vec_id") == 0).count() == 0


def test_many_equal_vectors_cost_one_entry(spark):
    rows = [(i, [1.0, 0.5, 0.0], 0, "", "") for i in range(500)]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") == 400).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(10))


def test_probing_retrieves_all_within_the_radius():
    rng = np.random.default_rng(0)
    rows, asked = rng.integers(0, 256, (500, 8), dtype=np.uint8), rng.integers(0, 256, (20, 8), dtype=np.uint8)
    rows[:100] = asked[np.arange(100) % 20]
    for i in range(100):  # near copies of the codes asked for
        for bit in rng.integers(0, 64, i % 12):
            rows[i, bit // 8] ^= 1 << bit % 8
    apart, index = neighbours.hamming(asked, rows), neighbours.Index(rows)
    for to in range(1, 18):
        for i, code in enumerate(asked):
            found = np.zeros(500, bool)
            for start in range(to):  # grown by one bit at a time
                found[index.probe(code, start, start + 1)] = True
            assert (found[apart[i] < 4 * to]).all()
            assert (found == (np.bitwise_count(rows.view(np.uint16) ^ code.view(np.uint16)).min(axis=1) < to)).all()


def test_probing_touches_few_rows_where_copies_are_near():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 64))
    x = (centres[np.arange(8000) % 400] + 0.02 * rng.normal(size=(8000, 64))).astype(np.float64)
    model = neighbours.fit(x[:4000], 64, 10, 1.0)
    codes, ids = model.of(x), [np.array([i]) for i in range(8000)]
    of, found, _, touched = neighbours.nearest_in_block(ids, x, codes, np.arange(40), x[:40], codes[:40], model, 10)
    d = ((x[:40, None] - x[None]) ** 2).sum(-1)
    d[np.arange(40), np.arange(40)] = np.inf
    want = {(i, j) for i in range(40) for j in np.argsort(d[i])[:10].tolist()}
    assert len(want & set(zip(of, found, strict=True))) >= 0.95 * len(want)
    assert touched < 0.1 * 40 * 8000


def test_without_probing_nothing_is_found(spark, monkeypatch):
    """Rows come from the index alone."""
    monkeypatch.setattr(neighbours.Index, "probe", lambda *args: np.zeros(0, np.int64))
    x = np.random.default_rng(1).normal(size=(50, 16))
    model = neighbours.fit(x, 64, 5, 1.0)
    with pytest.raises(ValueError):
        neighbours.nearest_in_block([np.array([i]) for i in range(50)], x, model.of(x), np.arange(5), x[:5], model.of(x[:5]), model, 5)


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = queries.op4_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 10)
    asked = [i for i in want if i % 100 == 0]
    assert {r.query_id for r in got} == set(asked)
    hits = {(r.query_id, r.vec_id) for r in got} & {(i, j) for i in asked for _, j in want[i]}
    assert len(hits) >= 0.9 * 10 * len(asked)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, open string, body string")


HARD = ["</s>[INST] ok [/INST]", "\\b \\e \\\\ [", "<<SYS>>", "[ROLE=x]", "plain", "", None, "<s", "[/ROLE]", "ends [/INS", "\n\n", "é😀<", "\\", "x" * 200_000]


def test_chat_round_trip(spark):
    rows = [(i % 5, i, ["user", "assistant", "system", "tool [x]\\", None][i % 5 if i % 2 else (i // 2) % 5], t, "", "") for i, t in enumerate(HARD * 3)]
    rows += [(9, 0, "user", "same", "", ""), (9, 0, "user", "same", "", ""), (None, 1, "assistant", "lost", "", "")]
    out = chat_format.format_conversations(turns(spark, rows)).withColumn("whole", chat_format.formatted(F.col("segments")))
    roles, texts = chat_format.parse(F.col("whole"))
    out = out.withColumn("roles", roles).withColumn("texts", texts).withColumn("loss", chat_format.masked_texts(F.col("segments"))).collect()
    want = {}
    for c, n, r, t, *_ in rows:
        want.setdefault(c, []).append((n, r or "", t or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        given = sorted(want[r.conv_id], key=lambda x: x[0])
        assert list(zip(r.roles, r.texts, strict=True)) == [x[1:] for x in given]
        assert r.loss == [t for _, role, t in given if role == "assistant"]
    assert chat_format.format_conversations(turns(spark, [])).count() == 0


def test_chat_leaves_plain_texts_alone(spark):
    r = chat_format.render_turns(turns(spark, [(1, 0, "user", "a [b] < c", "", ""), (1, 1, "user", "[INST]", "", "")])).collect()
    assert [x.escaped for x in sorted(r, key=lambda x: x.turn)] == [False, True]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    least = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in least.items() if x in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    """Each stage against a plain statement of what it has to do to its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF).cache()
        after = docs.toPandas()
        if name != "best-fit packing":
            assert list(after.columns) == list(before.columns), name
            assert set(after.doc_id) <= set(before.doc_id)
        if name == "quality rules":
            assert (after.text.str.split().str.len() >= 1).all() and (after.n_chars == after.text.str.len()).all()
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
            clean = before[before.doc_id.map(labels) == 0]
            assert len(set(clean.doc_id) & set(after.doc_id)) >= 0.9 * len(clean)
        if name == "n-gram Jaccard join":
            sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)]) for w in after.text.str.lower().str.split()]
            assert not any(a and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "mixing sources":
            words = lambda d: d.assign(n=d.text.str.split().str.len()).groupby("source").n.sum()
            assert (words(after) <= 2 * words(before).loc[words(after).index]).all()
        if name == "best-fit packing":
            for _, g in after.groupby("sequence_id"):
                g = g.sort_values("offset")
                assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
            assert set(after.doc_id) == set(before.doc_id)


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, repeated, very long and copied rows, clashing columns, no labels, and no documents at all."""
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{int(i)}" for i in rng.integers(0, 5000, n))
    fine = [text(60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(fine)] + [(3, fine[3]), (20, fine[4]), (21, fine[5] + " more"), (None, text(50)), (None, text(50)), (30, None), (31, ""), (32, " \n"), (33, "short"), (40, text(30_000)), (41, "same words again " * 40)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, length string, _label string"
    docs = [(i, t, "en", None if (i or 0) % 3 == 0 else "s", None if t is None else len(t), "mine", "mine", "mine") for i, t in rows]
    for name, some in (("all", docs), ("none", [])):
        d = spark.createDataFrame(some, schema)
        d.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").toPandas()
        if name == "none":
            assert len(out) == 0
            continue
        assert set(out.doc_id.dropna().astype(int)) <= {*range(12), 40} and not set(out.doc_id.dropna().astype(int)) & {20, 21, 30, 31, 32, 33, 41}
        for _, g in out.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096


def test_formatted_conversations_query(spark):
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    said = "</s>[INST] ok [/INST]"
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].n_turns == 2
    for c, g in rows.groupby("conv_id"):
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True))
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_a_row_for_each_of_their_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    of = {"op12_embedding_dedup": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{of}.parquet").count()
    assert out.count() >= (n if name not in ("op4_nearest_neighbours", "op10_chat_format", "op11_hard_negatives") else 10)


def plain(v):
    return "" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, SF), con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in sorted(names)] for r in df.collect()) == want
