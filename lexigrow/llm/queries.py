"""The operators applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrow.llm import (
    bpe,
    centroids,
    chat,
    context_mixing,
    lsh_forest,
    mixing,
    multi_index,
    nn_descent,
    quality,
    recompress,
    reshard,
    scan_search,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates on two-word shingles; one document of each group is kept."""
    found = lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def vocabulary() -> str:
    """The vocabulary file that the BPE query encodes with."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(toxicity.labelled_texts(docs, labels.where(~held_out)))
    scored = docs.select(
        "doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between embeddings of one label with a cosine of 0.93 or more."""
    found = nn_descent.embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def op3_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    found = scan_search.nearest(rows, F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, vocabulary()).withColumnRenamed("id", "doc_id")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of formatted conversations, read back from the formatted texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    done = chat.format_conversations(turns.union(probe))
    formatted = F.col("formatted")
    read = done.select(
        "id",
        chat.read_roles(formatted).alias("roles"),
        chat.read_texts(formatted).alias("texts"),
        F.array_join(chat.loss_texts(formatted, F.col("loss_spans")), "").alias("loss"),
        F.length(formatted).cast("long").alias("formatted_chars"),
    )
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document, learnt from those that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    found = context_mixing.score_texts(table(spark, sf_dir, "documents"), held_out)
    return found.withColumnRenamed("id", "doc_id")


def op7_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after windows of 20 words that occur earlier are cut out."""
    found = recompress.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    found = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, read back from the new shards."""
    rows, _ = reshard.reshard(table(spark, sf_dir, "documents"), shards=24)
    return rows.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Lloyd rounds of 16 integer centroids over every usable 64-component embedding."""
    vectors = centroids.integer_vectors(table(spark, sf_dir, "embeddings"))
    found, _ = centroids.cluster(vectors, k=16, rounds=3, salt="1")
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _centroid_sql(rounds: int = 3, k: int = 16, dims: int = 64, scale: int = 64) -> str:
    """Lloyd rounds unrolled as common table expressions."""
    parts = [f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT c, v FROM (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS c, v
    FROM v WHERE vec_id IS NOT NULL
  ) WHERE c < {k}
)"""]

    def assign(r: int) -> str:
        return f"""a{r} AS (
  SELECT v.rid, v.vec_id, v.v, min(
    list_sum(list_transform(range(1, {dims} + 1), lambda i: (v.v[i] - c{r}.v[i]) * (v.v[i] - c{r}.v[i]))) * 64
    + c{r}.c) AS m
  FROM v, c{r} GROUP BY v.rid, v.vec_id, v.v
)"""

    for r in range(rounds):
        parts.append(assign(r))
        parts.append(f"""s{r} AS (
  SELECT (m % 64)::BIGINT AS c, i, sum(v[i]) AS s, count(*) AS n
  FROM a{r}, range(1, {dims} + 1) t(i) GROUP BY ALL
), n{r} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c
), c{r + 1} AS (
  SELECT c{r}.c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c)
)""")
    parts.append(assign(rounds))
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT {last}.vec_id, (m % 64)::INTEGER AS cluster, (m // 64)::BIGINT AS distance,
  (sum(m // 64) OVER (PARTITION BY m % 64))::BIGINT AS cluster_inertia,
  (sum(m // 64) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON c{rounds}.c = m % 64
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of the threshold table for every document."""
    found = quality.judge(table(spark, sf_dir, "documents"), text="text", key="doc_id")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _quality_sql() -> str:
    """The measures and the rule table of ``quality`` in DuckDB."""
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    held = []
    for _, spec, least, most in quality.RULES:
        top, _, bottom = spec.partition(" / ")
        value = top if not bottom else f"({top}::DOUBLE / nullif({bottom}, 0))"
        if least is not None:
            held.append(f"coalesce({value} >= {least}, false)")
        if most is not None:
            held.append(f"coalesce({value} <= {most}, false)")
    blank = r"[ \t\x0B\f\r]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS ls
  FROM d
), win AS (
  SELECT rid, s, array_to_string(ws[s:s + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) t(s)
  WHERE len(ws) >= 5
), rep AS (
  SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2
), cov AS (SELECT rid, count(DISTINCT s + k) AS n FROM rep, range(0, 5) t(k) GROUP BY rid),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(ws, lambda x: regexp_replace(lower(x), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') IN ({stop})))
      AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
    len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…){blank}*$'))) AS n_ellipsis_lines,
    len(list_filter(ls, lambda l: regexp_matches(l, '^{blank}*[•·*\-]'))) AS n_bullet_lines
  FROM w LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {" AND ".join(held)} AS kept
FROM m
"""


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding: 5 positives, 10 negatives in 30 % to 90 %."""
    rows = multi_index.prepared(table(spark, sf_dir, "embeddings"), scale=256, relabel_every=7, classes=10)
    return multi_index.mine(rows, anchor_every=100, positives=5, negatives=10, low=30, high=90)


QUERIES = {
    "op11_multi_index": op11_multi_index,
    "op12_quality": op12_quality,
    "op13_centroids": op13_centroids,
    "op6_context_mixing": op6_context_mixing,
    "op2_nn_descent": op2_nn_descent,
    "op3_scan": op3_scan,
    "op5_chat": op5_chat,
    "op9_reshard": op9_reshard,
    "op1_toxicity": op1_toxicity,
    "op4_bpe": op4_bpe,
    "op8_mixing": op8_mixing,
    "op7_recompress": op7_recompress,
    "op10_lsh_forest": op10_lsh_forest,
}

ORACLE = {
    "op11_multi_index": r"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT id AS anchor_id, label AS al, v AS q FROM r WHERE id % 100 = 0),
s AS (
  SELECT anchor_id, al, id, label,
    list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * v[i]))::BIGINT AS score
  FROM a JOIN r ON len(r.v) = len(a.q)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k
    FROM s WHERE label = al AND id <> anchor_id
  ) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.al
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
""",
    "op13_centroids": _centroid_sql(),
    "op12_quality": _quality_sql(),
    "op2_nn_descent": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), good AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT DISTINCT u AS a, u AS b FROM l UNION SELECT reach.a, l.v FROM reach JOIN l ON reach.b = l.u
), root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root.root, vec_id) AS component_id,
  vec_id = coalesce(root.root, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN root ON root.a = vec_id
""",
    "op5_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), piece AS (
  SELECT *,
    regexp_replace(role, '[#:]', '\\\0', 'g') AS r2, replace(text, '\', '\\') AS t1,
    regexp_replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '#(## )', '\\#\1', 'g') AS t2
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(length(role) + 14 + CASE WHEN contains(text, '</turn>') OR contains(text, '### ')
    THEN length(t2) ELSE length(t1) END)::BIGINT AS formatted_chars
FROM piece GROUP BY conv_id
""",
    "op7_recompress": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents
), win AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20
), ranked AS (
  SELECT doc_id, s, row_number() OVER (
    PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM win
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE k > 1),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
left_over AS (
  SELECT word.doc_id, count(gone.i) AS n_removed,
    coalesce(string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL), '') AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
""",
    "op10_lsh_forest": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
  FROM w WHERE len(ws) > 0
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (
  SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.g) AS k
  FROM e JOIN f USING (g)
), p AS (SELECT doc_id, g FROM r WHERE k <= n - ceil(0.8 * n) + 1),
c AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
), l AS (
  SELECT u, v FROM c JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v
  WHERE 100 * len(list_intersect(a.sh, b.sh))
    >= 80 * (len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)))
), both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (
  SELECT DISTINCT u AS a, u AS b FROM both_ways
  UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u
), root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(len(s.sh), 0) AS BIGINT) AS n_shingles,
  coalesce(root.root, w.doc_id) AS component_id,
  w.doc_id = coalesce(root.root, w.doc_id) AS kept
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN root ON root.a = w.doc_id
""",
}
