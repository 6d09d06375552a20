"""The same results in DuckDB SQL, over the whole tables."""

from __future__ import annotations

from lexigrow.functions.text import WORD_PATTERN, default_stopwords
from lexigrow.operators.classifiers import NAMES
from suite.relational import CLUSTER_MIN_SIZE, FREQUENT, MAX_DF, MIN_DF, SEED

STOP = "(" + ", ".join(f"'{w}'" for w in default_stopwords()) + ")"


def tokens(text: str = "text") -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_PATTERN}', 1)"


def md5_order(*columns: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(columns)}))"


# Words with their position, of all documents.
WORDS = f"""
words AS (
  SELECT doc_id, lang, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
  FROM (SELECT doc_id, lang, {tokens()} AS toks FROM documents)
),
kept AS (SELECT * FROM words WHERE tok NOT IN {STOP})"""

# Unigrams and bigrams after stop-word removal.
TERMS = (
    WORDS
    + """,
terms AS (
  SELECT doc_id, tok AS term FROM kept
  UNION ALL
  SELECT doc_id, term FROM (
    SELECT doc_id, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS term
    FROM kept) WHERE term IS NOT NULL
)"""
)


def fitted(label: str, limit: int | None) -> str:
    """Vocabulary of the labelled documents with ``label`` = 1."""
    cap = f"ORDER BY cf DESC, term LIMIT {limit}" if limit else ""
    return (
        TERMS
        + f""",
fit AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE {label} = 1),
total AS (SELECT count(*) AS n FROM fit),
vocab AS (
  SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf
  FROM terms WHERE doc_id IN (SELECT doc_id FROM fit)
  GROUP BY term
  HAVING count(DISTINCT doc_id) >= {MIN_DF}
     AND count(DISTINCT doc_id) <= {MAX_DF} * (SELECT n FROM total)
  {cap}
)"""
    )


def weights(where: str) -> str:
    return f""",
counts AS (
  SELECT doc_id, term, count(*) AS tf, any_value(df) AS df
  FROM terms JOIN vocab USING (term) {where}
  GROUP BY doc_id, term
),
raw AS (
  SELECT doc_id, term, tf, tf * (ln((1.0 + (SELECT n FROM total)) / (1.0 + df)) + 1.0) AS r
  FROM counts
),
weights AS (
  SELECT doc_id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw
)"""


IN_FIT = "WHERE doc_id IN (SELECT doc_id FROM fit)"

TOP_TERMS = (
    "WITH "
    + fitted("quality", 300)
    + weights(IN_FIT)
    + """,
top AS (
  SELECT doc_id, term, round_even(w, 3) AS weight,
         row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term DESC) AS rank
  FROM weights QUALIFY rank <= 3
)"""
)

KEYWORDS = (
    TOP_TERMS
    + """
SELECT term AS keyword, sum(CAST(round(weight * 1000) AS BIGINT)) / (count(*) * 1000) AS tfidf_weight
FROM top GROUP BY term"""
)

SCORES = (
    "SELECT vec_id, CAST(label = 1 AS INTEGER) AS label, "
    + ", ".join(
        f"1 / (1 + exp(-(8 * CAST(embedding[{i + 1}] AS DOUBLE)))) AS y_pred_prob_{name}"
        for i, name in enumerate(NAMES)
    )
    + " FROM embeddings"
)
CLUSTER_SCORES = [n for n in NAMES if n != "SGD"]

METRIC_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS clf_name, label, CAST(y_pred_prob_{n} >= 0.5 AS INTEGER) AS guess FROM scores"
    for n in NAMES
)

# Clusters large enough, their contrast samples, and itemsets of one or two words.
CONTRAST = f"""
sizes AS (SELECT lang AS cluster, count(*) AS size FROM documents GROUP BY lang
          HAVING count(*) >= {CLUSTER_MIN_SIZE}),
members AS (SELECT doc_id, lang AS cluster FROM documents WHERE lang IN (SELECT cluster FROM sizes)),
sides AS (
  SELECT cluster, doc_id, 1 AS is_cluster FROM members
  UNION ALL
  SELECT cluster, doc_id, 0 FROM (
    SELECT s.cluster, m.doc_id, s.size,
           row_number() OVER (PARTITION BY s.cluster ORDER BY {md5_order('m.doc_id')}) AS r
    FROM sizes s JOIN members m ON m.cluster <> s.cluster) WHERE r <= size
),
side_sizes AS (
  SELECT cluster, CAST(sum(is_cluster) AS BIGINT) AS n1, CAST(sum(1 - is_cluster) AS BIGINT) AS n0
  FROM sides GROUP BY cluster
)"""

CLUSTER_VOCAB = """
present AS (SELECT DISTINCT doc_id, lang, tok FROM kept),
lang_sizes AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang),
cluster_vocab AS (
  SELECT lang AS cluster, tok AS term, df, n_docs FROM (
    SELECT lang, tok, count(*) AS df FROM present GROUP BY lang, tok) JOIN lang_sizes USING (lang)
  WHERE df >= 0.1 * n_docs AND df <= 0.5 * n_docs
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY df DESC, tok) <= 1000
)"""

ITEMSETS = (
    "WITH "
    + WORDS
    + ","
    + CLUSTER_VOCAB
    + ","
    + CONTRAST
    + """,
basket AS (
  SELECT s.cluster, s.doc_id, s.is_cluster, p.tok AS item
  FROM sides s JOIN present p USING (doc_id)
  JOIN cluster_vocab v ON v.cluster = s.cluster AND v.term = p.tok
),
singles AS (
  SELECT cluster, item, CAST(sum(is_cluster) AS BIGINT) AS c1,
         CAST(sum(1 - is_cluster) AS BIGINT) AS c0, any_value(n1) AS n1, any_value(n0) AS n0
  FROM basket JOIN side_sizes USING (cluster) GROUP BY cluster, item
  HAVING count(*) / (any_value(n1) + any_value(n0)) >= 0.1
),
frequent AS (SELECT b.* FROM basket b JOIN singles s ON s.cluster = b.cluster AND s.item = b.item),
joint AS (
  SELECT x.cluster, x.item AS a, y.item AS b, CAST(sum(x.is_cluster) AS BIGINT) AS c1,
         CAST(sum(1 - x.is_cluster) AS BIGINT) AS c0, any_value(n1) AS n1, any_value(n0) AS n0
  FROM frequent x JOIN frequent y
    ON x.cluster = y.cluster AND x.doc_id = y.doc_id AND x.is_cluster = y.is_cluster
   AND x.item < y.item
  JOIN side_sizes z ON z.cluster = x.cluster
  GROUP BY x.cluster, x.item, y.item
  HAVING count(*) / (any_value(n1) + any_value(n0)) >= 0.1
),
itemsets AS (
  SELECT cluster, item AS items, item AS glued, item AS comma, c1, n1, c0, n0,
         (c1 + c0) / (n1 + n0) AS support FROM singles
  UNION ALL
  SELECT j.cluster, a || ' ' || b, a || b, a || ',' || b, s.c1 + t.c1 - j.c1, j.n1,
         s.c0 + t.c0 - j.c0, j.n0, (j.c1 + j.c0) / (j.n1 + j.n0)
  FROM joint j JOIN singles s ON s.cluster = j.cluster AND s.item = j.a
  JOIN singles t ON t.cluster = j.cluster AND t.item = j.b
),
ranked AS (
  SELECT *, lgamma(c1 + 1) + lgamma(c0 + 1) - lgamma(c1 + c0 + 2)
          + lgamma(n1 - c1 + 1) + lgamma(n0 - c0 + 1) - lgamma(n1 + n0 - c1 - c0 + 2) AS likelihood
  FROM itemsets
),
top AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(likelihood, 6) DESC, items) AS rank
  FROM ranked QUALIFY rank <= 10
),
"""
    + f"""freq AS (SELECT tok AS word, count(*) AS freq FROM words GROUP BY tok
         ORDER BY freq DESC, word LIMIT {FREQUENT}),
best AS (SELECT * FROM top WHERE glued NOT IN (SELECT word FROM freq))"""
)

TEXT_SIZE = "len(toks) AS n_tokens, md5(array_to_string(toks, '|')) AS tokens_md5"

# Rows and features of the lasso, with the constant (-2) and the target (-1) as features.
LASSO_ROWS = (
    "WITH "
    + fitted("toxic", 100)
    + f""",
lab AS (SELECT doc_id, toxic AS y FROM documents JOIN labels USING (doc_id)),
chosen AS (
  SELECT doc_id, y FROM lab WHERE y = 1
  UNION ALL
  SELECT doc_id, y FROM (
    SELECT doc_id, y, row_number() OVER (ORDER BY {md5_order('doc_id')}) AS r FROM lab WHERE y = 0)
  WHERE r <= (SELECT count(*) FROM lab WHERE y = 1)
),
lasso_rows AS (
  SELECT doc_id, y,
         CAST((row_number() OVER (PARTITION BY y ORDER BY {md5_order('y', 'doc_id')}) - 1) % 5
              AS INTEGER) AS fold
  FROM chosen
)"""
)

NEIGHBOURS = """
WITH seeds AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)
),
sims AS (
  SELECT s.vec_id AS seed, v.vec_id,
         list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS sim
  FROM seeds s JOIN embeddings v ON s.vec_id <> v.vec_id
),
near AS (
  SELECT seed, vec_id, round(sim, 6) AS similarity,
         row_number() OVER (PARTITION BY seed ORDER BY round(sim, 12) DESC, vec_id) AS rank
  FROM sims QUALIFY rank <= 25
)"""


def split_by(label: str) -> str:
    """``parts``: labelled documents with their side of the stratified 80/20 split."""
    return f"""
class_sizes AS (SELECT {label} AS y, count(*) AS n FROM labels GROUP BY {label}),
goal AS (SELECT count(*) AS t, count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS train FROM labels),
shares AS (SELECT y, n * train / t AS share, floor(n * train / t) AS f FROM class_sizes, goal),
quota AS (
  SELECT y, f + CAST(row_number() OVER (ORDER BY share - f DESC, y)
         <= (SELECT train FROM goal) - (SELECT sum(f) FROM shares) AS INTEGER) AS q FROM shares
),
parts AS (
  SELECT doc_id, {label}, CASE WHEN r <= q THEN 'train' ELSE 'test' END AS split
  FROM (SELECT doc_id, {label}, row_number() OVER (
          PARTITION BY {label} ORDER BY {md5_order(label, 'doc_id')}) AS r FROM labels)
  JOIN quota ON y = {label}
)"""


# Weights of all labelled documents under the vocabulary of the training part.
TRAIN_WEIGHTS = (
    "WITH "
    + TERMS
    + ","
    + split_by("toxic")
    + f""",
total AS (SELECT count(*) AS n FROM parts WHERE split = 'train'),
vocab AS (
  SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf
  FROM terms WHERE doc_id IN (SELECT doc_id FROM parts WHERE split = 'train')
  GROUP BY term
  HAVING count(DISTINCT doc_id) >= {MIN_DF}
     AND count(DISTINCT doc_id) <= {MAX_DF} * (SELECT n FROM total)
  ORDER BY cf DESC, term LIMIT 100
)"""
    + weights("")
)

TRAIN_FEATURES = (
    TRAIN_WEIGHTS
    + """
SELECT p.doc_id, p.toxic, CASE split WHEN 'train' THEN split ELSE 'validation' END AS split,
       CAST(count(term) AS INTEGER) AS n_terms, round(coalesce(sum(w), 0), 6) AS weight_sum
FROM parts p LEFT JOIN weights USING (doc_id) GROUP BY p.doc_id, p.toxic, split"""
)

# Gaussian naive Bayes; absent terms count as zeros. A billionth of the largest variance is
# added to every variance.
NAIVE_BAYES = (
    TRAIN_WEIGHTS
    + """,
train AS (SELECT doc_id, toxic AS y FROM parts WHERE split = 'train'),
class_n AS (SELECT y, count(*) AS n FROM train GROUP BY y),
sums AS (SELECT y, term, sum(w) AS s, sum(w * w) AS q FROM weights JOIN train USING (doc_id)
         GROUP BY y, term),
extra AS (SELECT max(q - s * s) * 1e-9 AS e FROM (
  SELECT term, sum(s) / (SELECT n FROM total) AS s, sum(q) / (SELECT n FROM total) AS q
  FROM sums GROUP BY term)),
gauss AS (
  SELECT c.y, v.term, coalesce(s, 0) / n AS m,
         coalesce(q, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n) + (SELECT e FROM extra) AS var
  FROM class_n c JOIN vocab v ON true LEFT JOIN sums x ON x.y = c.y AND x.term = v.term
),
base AS (SELECT g.y, ln(any_value(n)) - sum(0.5 * ln(var) + m * m / (2 * var)) AS b
         FROM gauss g JOIN class_n c ON c.y = g.y GROUP BY g.y),
gain AS (SELECT doc_id, y, sum((m * m - (w - m) * (w - m)) / (2 * var)) AS g
         FROM weights JOIN gauss USING (term) GROUP BY doc_id, y),
logs AS (SELECT d.doc_id, b.y, b.b + coalesce(g.g, 0) AS l
         FROM documents d JOIN base b ON true LEFT JOIN gain g ON g.doc_id = d.doc_id AND g.y = b.y),
both_logs AS (SELECT doc_id, max(l) FILTER (y = 0) AS l0, max(l) FILTER (y = 1) AS l1
              FROM logs GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN l0 - l1 > 700 THEN 0.0 ELSE 1 / (1 + exp(l0 - l1)) END, 6)
       AS "y_pred_prob_NaiveBayes" FROM both_logs"""
)

ORACLE = {
    "train_features": TRAIN_FEATURES,
    "clf_naive_bayes": NAIVE_BAYES,
    "labelled_docs": f"""SELECT doc_id, quality, toxic, len({tokens()}) AS n_tokens
        FROM documents JOIN labels USING (doc_id)""",
    "positive_docs": f"""SELECT doc_id, len({tokens()}) AS n_tokens
        FROM documents JOIN labels USING (doc_id) WHERE quality = 1""",
    "lower_text": "SELECT doc_id, md5(lower(text)) AS text_md5 FROM documents",
    "tokens_space": f"""SELECT doc_id, {TEXT_SIZE}
        FROM (SELECT doc_id, string_split(text, ' ') AS toks FROM documents)""",
    "tokens_mixed": f"""SELECT doc_id, form, {TEXT_SIZE} FROM (
        SELECT doc_id, 'list' AS form, CASE WHEN len(found) = 0 THEN [''] ELSE found END AS toks
        FROM (SELECT doc_id, {tokens().replace("lower(text)", "text")} AS found FROM documents)
        UNION ALL
        SELECT doc_id, 'prose', string_split('[' || doc_id || '] ' || text, ' ') FROM documents)""",
    "tokens_words": f"""SELECT doc_id, {TEXT_SIZE}
        FROM (SELECT doc_id, {tokens()} AS toks FROM documents)""",
    "stopword_filter": f"""WITH {WORDS}, lists AS (
        SELECT doc_id, list(tok ORDER BY pos) AS toks FROM kept GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(toks), 0) AS n_tokens,
               md5(coalesce(array_to_string(toks, '|'), '')) AS tokens_md5
        FROM documents d LEFT JOIN lists USING (doc_id)""",
    "ngram_counts": f"""WITH {TERMS}
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY term""",
    "vocab_stats": f"WITH {fitted('quality', None)} SELECT term, df, cf FROM vocab",
    "vocab_topn": f"WITH {fitted('quality', 300)} SELECT term, df, cf FROM vocab",
    "cluster_vocab": f"WITH {WORDS}, {CLUSTER_VOCAB} SELECT cluster, term, df, n_docs FROM cluster_vocab",
    "freq_words": f"""WITH {WORDS} SELECT tok AS word, count(*) AS freq FROM words GROUP BY tok
        ORDER BY freq DESC, word LIMIT {FREQUENT}""",
    "tfidf_weights": f"""WITH {fitted('quality', None)} {weights(IN_FIT)}
        SELECT doc_id, term, tf, round(w, 6) AS w FROM weights""",
    "tfidf_apply": f"""WITH {fitted('quality', 300)} {weights('')}
        SELECT doc_id, term, tf, round(w, 6) AS w FROM weights""",
    "tfidf_top_terms": TOP_TERMS + " SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, weight FROM top",
    "tfidf_keywords": KEYWORDS,
    "tfidf_keywords_top10": KEYWORDS + " ORDER BY tfidf_weight DESC, keyword LIMIT 10",
    "class_balance_sample": f"""SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (
        PARTITION BY quality ORDER BY {md5_order('quality', 'doc_id')}) <= 40""",
    "cap_sample": f"SELECT doc_id, lang FROM documents ORDER BY {md5_order('doc_id')} LIMIT 150",
    "matched_negatives": f"""SELECT doc_id, toxic FROM labels WHERE toxic = 0
        QUALIFY row_number() OVER (ORDER BY {md5_order('doc_id')})
                <= (SELECT sum(toxic) FROM labels)""",
    "cluster_contrast": f"""WITH sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
        SELECT d.doc_id, d.lang, s.lang AS contrast_of
        FROM sizes s JOIN documents d ON d.lang <> s.lang
        QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY {md5_order('d.doc_id')}) <= s.n""",
    "stratified_split": f"WITH {split_by('quality')} SELECT doc_id, quality, split FROM parts",
    "stratified_folds": f"""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
        ORDER BY {md5_order('quality', 'doc_id')}) - 1) % 5 AS INTEGER) AS fold FROM labels""",
    "chunk_by_total": """SELECT doc_id, (p * 7 + n - 1) // n - 1 AS chunk FROM (
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, count(*) OVER () AS n
        FROM documents)""",
    "chunk_by_size": """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk
        FROM documents""",
    "class_weights": """SELECT doc_id, toxic, (SELECT count(*) FROM labels)
        / ((SELECT count(DISTINCT toxic) FROM labels) * count(*) OVER (PARTITION BY toxic))
        AS weight FROM labels""",
    "score_matrix": f"WITH scores AS ({SCORES}) SELECT vec_id, "
    + ", ".join(f"round(y_pred_prob_{n}, 6) AS y_pred_prob_{n}" for n in CLUSTER_SCORES)
    + " FROM scores",
    "ensemble_any_positive": f"WITH scores AS ({SCORES}) SELECT vec_id FROM scores WHERE greatest("
    + ", ".join(f"y_pred_prob_{n}" for n in NAMES)
    + ") >= 0.8",
    "predicted_label": f"WITH scores AS ({SCORES}) SELECT vec_id, y_pred_prob_SGD >= 0.5 AS y FROM scores",
    "softmax_score": """SELECT vec_id, round(exp(z1) / (exp(z0) + exp(z1)), 6) AS score FROM (
        SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS z0,
               CAST(embedding[2] AS DOUBLE) * 10 AS z1 FROM embeddings)""",
    "clf_metrics": f"""WITH scores AS ({SCORES}), guesses AS ({METRIC_ROWS}), m AS (
        SELECT clf_name, count(*) FILTER (label = 1 AND guess = 1) AS tp,
               count(*) FILTER (label = 0 AND guess = 1) AS fp,
               count(*) FILTER (label = 1 AND guess = 0) AS fn,
               count(*) FILTER (label = 0 AND guess = 0) AS tn FROM guesses GROUP BY clf_name)
        SELECT clf_name, tp, fp, fn, tn, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
               coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
               coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
               (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM m""",
    "clf_auc": """WITH s AS (SELECT CAST(label = 1 AS INTEGER) AS y,
               CAST(embedding[1] AS DOUBLE) AS score FROM embeddings),
        r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r
              FROM s)
        SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2)
                     / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""",
    "batch_scores": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        e AS (SELECT vec_id, label, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
        c AS (SELECT i, avg(x) FILTER (label = 1) AS w1, avg(x) FILTER (label <> 1) AS w0
              FROM e GROUP BY i),
        z AS (SELECT vec_id, label, sum(x * w0) AS z0, sum(x * w1) AS z1 FROM e JOIN c USING (i)
              GROUP BY vec_id, label)
        SELECT vec_id, label, round(exp(z1) / (exp(z0) + exp(z1)), 6) AS y_pred_prob_BERT FROM z""",
    "cluster_counts": """SELECT lang AS cluster, count(doc_id) AS doc_id, count(text) AS text,
        count(source) AS source, count(n_chars) AS n_chars FROM documents GROUP BY lang""",
    "distinct_clusters": "SELECT count(DISTINCT lang) AS n_clusters FROM documents",
    "cluster_size_filter": f"""SELECT doc_id, lang AS cluster, count(*) OVER (PARTITION BY lang)
        AS cluster_count FROM documents QUALIFY cluster_count >= {CLUSTER_MIN_SIZE}""",
    "cluster_itemsets": ITEMSETS
    + " SELECT cluster, items, support FROM itemsets",
    "itemset_likelihood": ITEMSETS
    + " SELECT cluster, items, c1, n1, c0, n0, round(likelihood, 6) AS likelihood FROM ranked",
    "itemset_top10": ITEMSETS
    + """ SELECT cluster, CAST(rank AS INTEGER) AS rank, items, round(likelihood, 6) AS likelihood
        FROM top""",
    "itemsets_not_frequent": ITEMSETS
    + " SELECT cluster, CAST(rank AS INTEGER) AS rank, items FROM best",
    "cluster_keywords": ITEMSETS
    + """ SELECT items AS keywords, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters,
        round(avg(support), 6) AS support FROM best GROUP BY items""",
    "cluster_summary": ITEMSETS
    + """ SELECT cluster, any_value(n1) AS size, string_agg('(' || comma || ', '
        || CAST(round_even(support, 2) AS VARCHAR) || ')', ';' ORDER BY rank) AS keywords
        FROM best GROUP BY cluster""",
    "itemset_presence": f"""WITH {WORDS}, {CLUSTER_VOCAB}, {CONTRAST.replace(
        f'HAVING count(*) >= {CLUSTER_MIN_SIZE}', '')},
        ranked AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY df DESC, term)
                   AS r FROM cluster_vocab QUALIFY r <= 10),
        sets AS (SELECT cluster, r AS set_id, term AS item FROM ranked
                 UNION ALL SELECT cluster, r - 1, term FROM ranked WHERE r > 1),
        tokens AS (SELECT DISTINCT doc_id, tok FROM words),
        hits AS (SELECT s.cluster, t.set_id, s.is_cluster, count(DISTINCT s.doc_id) AS has_item
                 FROM sides s JOIN tokens p USING (doc_id)
                 JOIN sets t ON t.cluster = s.cluster AND t.item = p.tok GROUP BY ALL),
        grid AS (SELECT DISTINCT cluster, set_id, unnest([0, 1]) AS is_cluster FROM sets),
        n AS (SELECT cluster, is_cluster, count(DISTINCT doc_id) AS n_rows FROM sides GROUP BY ALL)
        SELECT g.cluster, g.set_id, g.is_cluster, coalesce(n_rows, 0) AS n_rows,
               coalesce(has_item, 0) AS has_item
        FROM grid g LEFT JOIN n USING (cluster, is_cluster)
        LEFT JOIN hits USING (cluster, set_id, is_cluster)""",
    "fpgrowth_itemsets": f"""WITH {WORDS},
        present AS (SELECT DISTINCT doc_id, tok FROM kept),
        n AS (SELECT count(*) AS n FROM documents),
        one AS (SELECT tok, count(*) AS freq FROM present GROUP BY tok
                HAVING count(*) >= ceil(0.1 * (SELECT n FROM n))),
        common AS (SELECT p.* FROM present p JOIN one USING (tok))
        SELECT tok AS items, freq FROM one
        UNION ALL
        SELECT x.tok || ' ' || y.tok, count(*) FROM common x JOIN common y
          ON x.doc_id = y.doc_id AND x.tok < y.tok GROUP BY x.tok, y.tok
        HAVING count(*) >= ceil(0.1 * (SELECT n FROM n))""",
    "fpgrowth_triples": f"""WITH {WORDS},
        present AS (SELECT DISTINCT doc_id, tok FROM kept),
        n AS (SELECT ceil(0.12 * count(*)) AS least FROM documents),
        one AS (SELECT tok, count(*) AS freq FROM present GROUP BY tok
                HAVING count(*) >= (SELECT least FROM n)),
        common AS (SELECT p.* FROM present p JOIN one USING (tok))
        SELECT tok AS items, freq FROM one
        UNION ALL
        SELECT x.tok || ' ' || y.tok, count(*) FROM common x JOIN common y
          ON x.doc_id = y.doc_id AND x.tok < y.tok GROUP BY x.tok, y.tok
        HAVING count(*) >= (SELECT least FROM n)
        UNION ALL
        SELECT x.tok || ' ' || y.tok || ' ' || z.tok, count(*) FROM common x JOIN common y
          ON x.doc_id = y.doc_id AND x.tok < y.tok JOIN common z
          ON z.doc_id = y.doc_id AND y.tok < z.tok GROUP BY x.tok, y.tok, z.tok
        HAVING count(*) >= (SELECT least FROM n)""",
    "lasso_input": LASSO_ROWS + " SELECT doc_id, y, fold FROM lasso_rows",
    "lasso_moments": LASSO_ROWS
    + weights("WHERE doc_id IN (SELECT doc_id FROM lasso_rows)")
    + """,
    numbered AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM vocab),
    entries AS (
      SELECT doc_id, i, w AS x FROM weights JOIN numbered USING (term)
      UNION ALL SELECT doc_id, -2, 1.0 FROM lasso_rows
      UNION ALL SELECT doc_id, -1, y FROM lasso_rows
    )
    SELECT fold, CAST(p.i AS INTEGER) AS a, CAST(q.i AS INTEGER) AS b, round(sum(p.x * q.x), 6) AS total
    FROM lasso_rows JOIN entries p USING (doc_id) JOIN entries q USING (doc_id)
    WHERE p.i <= q.i GROUP BY fold, p.i, q.i""",
    "cosine_topk": NEIGHBOURS + " SELECT seed, vec_id, CAST(rank AS INTEGER) AS rank, similarity FROM near",
    "cosine_expansion": NEIGHBOURS + " SELECT DISTINCT vec_id FROM near",
}
