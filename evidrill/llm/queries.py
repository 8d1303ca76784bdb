"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, hard_negatives, jaccard_join, licenses, mixing, neighbours, packing, quality_rules, token_counts, token_output, toxicity, vector_dedup
from .common import documents, materialize, shared_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = quality_rules.score(documents(spark, sf_dir))
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_words", "depleted",
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "token-output")
    token_output.write(documents(spark, sf_dir), out, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_output.read_digests(spark, out)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir), n=3, similarity=jaccard_join.Similarity(90, 100))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def usable_label() -> Column:
    """Labels to learn from: those of rows that aren't held out."""
    return ~held_out(F.col("doc_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, usable_label()))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    hard = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    written = materialize(chat_format.format_conversations(turns.unionByName(hard)), "chat-formatted")
    read = written.withColumn("formatted", chat_format.formatted(F.col("segments")))
    roles, texts = chat_format.parse(F.col("formatted"))
    read = read.withColumn("roles", roles).withColumn("texts", texts)
    whole = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join(chat_format.masked_texts(F.col("segments")), "")
    return read.select(
        "conv_id", F.size("roles").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, moved)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_token_output": op3_token_output,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_chat_format": op10_chat_format,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_token_alignment": op13_token_alignment,
}
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_LINE = r"lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')))"
_WEIGHT = "(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END)"
#: Vectors that hold finite numbers alone.
_FINITE = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))"
_ESCAPED = "replace(replace(replace(replace(text, '\\', '\\e'), '[', '\\b'), ']', '\\d'), '<', '\\l')"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents), w AS (SELECT row, doc_id, t, {_WORDS} AS w FROM d),
win AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, x) > 1),
cov AS (SELECT row, count(DISTINCT i + k) AS n FROM rep CROSS JOIN range(0, 8) r(k) GROUP BY ALL),
l AS (SELECT row, source, l FROM (SELECT row, source, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT row, count(*) - count(DISTINCT l) AS n FROM l GROUP BY ALL),
line AS (SELECT row, source, {_LINE} AS h, sum(len({_WORDS.replace("(t,", "(l,")})) AS n FROM l GROUP BY ALL),
content AS (SELECT row, md5(array_to_string(list_sort(list(h)), chr(10))) AS c FROM line GROUP BY ALL),
f AS (SELECT source, h FROM line JOIN content USING (row) GROUP BY ALL HAVING count(DISTINCT c) > 10),
s2 AS (SELECT row, sum(n) AS n FROM line WHERE EXISTS (FROM f WHERE f.source IS NOT DISTINCT FROM line.source AND f.h = line.h) GROUP BY ALL),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, CAST(coalesce(s2.n, 0) AS BIGINT) AS n_removed_words FROM w LEFT JOIN dup USING (row) LEFT JOIN cov USING (row) LEFT JOIN s2 USING (row)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed_words < 0.3 * n_words AS depleted FROM m)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v""",
    "op2_source_mix": rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, source, len({_WORDS}) AS size, -ln((('0x' || substr(md5(concat_ws('|', 'mix', doc_id, coalesce(source, ''))), 1, 12))::BIGINT + 0.5e0) / 281474976710656e0)
  / (0.5e0 + CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '[\p{{L}}\x20]+', '', 'g'))) / length(t)::DOUBLE ELSE 0e0 END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY ALL),
c AS (SELECT *, {_WEIGHT} AS weight, source_size * 2e0 AS cap, source_size * 2e0 / {_WEIGHT} AS ratio FROM s),
e AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM e WHERE level <= ratio) * weight, cap)) AS target FROM e),
p AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN before + size / 2e0 < target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM b""",
    "op6_license_scan": licenses.plain_sql(),
    "op10_chat_format": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) r(i)),
f AS (SELECT *, length(CASE WHEN conv_id = -7 THEN {_ESCAPED} ELSE text END) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY ALL""",
    "op11_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) <= 5""",
    "op12_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT a, min(b) AS b FROM r GROUP BY ALL),
o AS (SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, c.b) AS component_id FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a)
SELECT *, vec_id = component_id AS kept FROM o""",
}
