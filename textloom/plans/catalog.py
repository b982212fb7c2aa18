"""The named queries: ``queries()`` runs them on Spark, ``oracle_sql()`` has SQL that gives the same rows.

Scores that need a model come from stand-in logits, which are plain arithmetic, so that everything after the model
can be checked. Floats are rounded to six places.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scorers
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import chunk, contain, evaluate, index, pairs, rank, retrieve, spans, token_table
from textloom.operators.numbering import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HYPOTHESES = ["This is about people.", "This is about places.", "This is about numbers.", "This is about nothing."]
LABELS = ["person", "place", "thing"]
BIO = ["O", "B-PERSON", "I-PERSON", "B-EMAIL", "I-EMAIL"]
QUESTION = "the and of to in that is with for by"
#: Fixed value: what white space is in SQL, where ``\s`` is ASCII only.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_SQL = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+(?:[-_][\p{L}\p{M}\p{Nd}\p{Pc}]+)*|[^" + SPACE + "]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(v: Column | str) -> Column:
    return F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0))


def one_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


E_ = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
U_ = E_ + ", u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END)) AS v FROM e)"


# Vectors and retrieval


@query(f"WITH {E_}, q AS (SELECT v AS q FROM e WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 5")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve.top_k(table(spark, sf_dir, "embeddings"), one_vector(spark, sf_dir), k=5, id_col="vec_id")
    return hits.select("vec_id", r6("score").alias("score"))


@query(f"""WITH {E_}, s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS score FROM e, e q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank < 10""")
def retrieve_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.top_k_batch(e, asked, k=10, id_col="vec_id").select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query(SQL["retrieve_topk_batch"])
def retrieve_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.top_k_cells(e, asked, k=10, id_col="vec_id").select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query(f"WITH {U_} SELECT vec_id, list_transform(v, lambda x: round(x, 6) + 0.0) AS unit FROM u")
def embed_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(V.unit("embedding")).alias("unit"))


@query(f"""WITH {E_}, z AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE x * (vec_id % 5) END) AS v FROM e)
SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm,
 round(CASE WHEN list_inner_product(v, v) = 0 THEN 0 ELSE 1 END, 6)::DOUBLE AS unit_norm FROM z""")
def embed_zero_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(V.doubles("embedding"), lambda x: F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(x * (F.col("vec_id") % 5)))
    z = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    return z.select("vec_id", r6(V.norm("v")).alias("norm"), r6(V.norm(V.unit("v"))).alias("unit_norm"))


@query(f"""WITH {E_} SELECT count(*)::BIGINT AS n, min(len(v))::INTEGER AS min_dim, max(len(v))::INTEGER AS max_dim,
 count(*) FILTER (abs(sqrt(list_inner_product(v, v)) - 1) > 1e-3)::BIGINT AS n_not_unit, round(max(abs(sqrt(list_inner_product(v, v)) - 1)), 6) AS worst FROM e""")
def norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(V.norm("embedding") - 1)
    e = table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("dim"), off.alias("off"))
    return e.agg(F.count("*").alias("n"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"), F.count_if(F.col("off") > 1e-3).alias("n_not_unit"), r6(F.max("off")).alias("worst"))


C_ = U_ + """, d AS (SELECT label, i, avg(v[i]) AS x FROM u, unnest(range(1, 65)) t(i) GROUP BY label, i),
m AS (SELECT label, list(x ORDER BY i) AS c FROM d GROUP BY label),
c AS (SELECT label, list_transform(c, lambda x: x / (CASE WHEN list_inner_product(c, c) = 0 THEN 1 ELSE sqrt(list_inner_product(c, c)) END)) AS c FROM m)"""


@query(f"WITH {C_} SELECT label, list_transform(c, lambda x: round(x, 6) + 0.0) AS centroid FROM c")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.centroids(table(spark, sf_dir, "embeddings"), "label").select("label", rounded("centroid").alias("centroid"))


@query(f"WITH {C_} SELECT vec_id, label, round(list_cosine_similarity(v, c), 6) AS score FROM u JOIN c USING (label)")
def label_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.salience(table(spark, sf_dir, "embeddings"), "label").select("vec_id", "label", r6("score").alias("score"))


@query(f"""WITH {C_}, s AS (SELECT vec_id, label, list_cosine_similarity(v, c) AS score FROM u JOIN c USING (label)),
r AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM s)
SELECT label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank < 10""")
def centroid_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rank.ranked(rank.salience(table(spark, sf_dir, "embeddings"), "label"), "label", "vec_id", 10)
    return best.select("label", "vec_id", "rank", r6("score").alias("score"))


@query(f"""WITH {U_}, q AS (SELECT v AS q FROM u WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(v, q) AS score FROM u, q),
r AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1)::INTEGER AS rank FROM s)
SELECT label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank < 10""")
def query_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieve.scored(table(spark, sf_dir, "embeddings"), one_vector(spark, sf_dir))
    return rank.ranked(scored, "label", "vec_id", 10).select("label", "vec_id", "rank", r6("score").alias("score"))


def _mmr_sql(k: int) -> str:
    parts = [f"WITH {U_}, q AS (SELECT v AS q FROM u WHERE vec_id = 0), s0 AS (SELECT vec_id, label, v, list_cosine_similarity(v, q) AS score, -2.0::DOUBLE AS near FROM u, q)"]
    for i in range(k):
        value = "score" if i == 0 else "0.7 * score - 0.3 * near"
        parts.append(f"p{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {value} DESC, vec_id) AS n FROM s{i}) WHERE n = 1)")
        parts.append(f"s{i + 1} AS (SELECT s.vec_id, s.label, s.v, s.score, greatest(s.near, list_inner_product(s.v, p.v)) AS near FROM s{i} s JOIN p{i} p USING (label) WHERE s.vec_id <> p.vec_id)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT label, vec_id, {i} AS rank, round(score, 6) AS score FROM p{i}" for i in range(k))


@query(_mmr_sql(4))
def mmr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieve.scored(table(spark, sf_dir, "embeddings"), one_vector(spark, sf_dir))
    return rank.mmr(scored, "label", "vec_id", 4, 0.3).select("label", "vec_id", "rank", r6("score").alias("score"))


@query(f"""WITH {U_}, t AS (SELECT vec_id, list_transform(range(0, 8), lambda i: v[i * 8 + 1 : i * 8 + 8]) AS h, vec_id % 9 AS n FROM u)
SELECT vec_id, list_transform(range(1, 9), lambda j: round(CASE WHEN n = 0 THEN 0 ELSE list_sum(list_transform(h[1:n], lambda r: r[j])) / n END, 6) + 0.0) AS pooled FROM t""")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden, mask = _hidden()
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(V.masked_mean(hidden, mask, 8)).alias("pooled"))


@query(f"WITH {U_} SELECT vec_id, list_transform(v[1:8], lambda x: round(x, 6) + 0.0) AS pooled FROM u")
def cls_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(V.first_token(_hidden()[0])).alias("pooled"))


def _hidden() -> tuple[Column, Column]:
    """An embedding read as 8 tokens of 8 values, of which the first vec_id % 9 are not padding."""
    unit = V.unit("embedding")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(unit, i * 8 + 1, F.lit(8)))
    return tokens, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < F.col("vec_id") % 9).cast("int"))


# Ordered scans


@query(f"""WITH {U_}, a AS (SELECT vec_id, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM u)
SELECT vec_id, label, round(list_cosine_similarity(v, b), 6) AS sim FROM a""")
def adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A label may have any share of the rows.
    return chunk.adjacent_cosine(table(spark, sf_dir, "embeddings"), "label", "vec_id", spread=True).select("vec_id", "label", r6("sim").alias("sim"))


PACK_SQL = """, r AS (SELECT parent, i, tokens, tokens AS held, 0 AS chunk, pos FROM n WHERE i = 0 UNION ALL
SELECT n.parent, n.i, n.tokens, CASE WHEN {cut} THEN n.tokens ELSE r.held + n.tokens END, r.chunk + CASE WHEN {cut} THEN 1 ELSE 0 END, n.pos FROM r JOIN n ON n.parent = r.parent AND n.i = r.i + 1)
SELECT parent, chunk, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos, sum(tokens)::BIGINT AS tokens, list(i::INTEGER ORDER BY i) AS unit_indices FROM r GROUP BY parent, chunk"""


@query(f"""WITH RECURSIVE {U_}, a AS (SELECT vec_id // 50 AS parent, vec_id AS pos, vec_id % 7 + 1 AS tokens, v, lag(v) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS b,
 row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1 AS i FROM u), n AS (SELECT parent, pos, tokens, i, list_cosine_similarity(v, b) AS sim FROM a)"""
    + PACK_SQL.format(cut="(n.sim < 0.1 OR r.held + n.tokens > 12)"))
def semantic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("parent"), F.col("vec_id").alias("pos"), (F.col("vec_id") % 7 + 1).alias("tokens"), "embedding")
    return chunk.pack(chunk.adjacent_cosine(units, "parent", "pos"), "parent", "pos", max_tokens=12, drop_threshold=0.1)


@query(r"""WITH RECURSIVE l AS (SELECT doc_id AS parent, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
n AS (SELECT parent, i, i AS pos, len(regexp_extract_all(line, '[^""" + SPACE + r"""]+')) AS tokens FROM l)""" + PACK_SQL.format(cut="(r.held + n.tokens > 64)"))
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    units = each.select("parent", F.col("pos").cast("bigint").alias("pos"), T.token_count("line").alias("tokens"))
    return chunk.pack(units, "parent", "pos", max_tokens=64, sim=None)


# Index building


@query("SELECT doc_id, text, source AS external_id FROM documents UNION ALL SELECT item_id + 1000000000 AS doc_id, text, NULL AS external_id FROM benchmark")
def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("external_id"))
    return index.append(old, table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), "text"))


@query("""WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT 'hit' AS kind, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS texts FROM documents WHERE text IN (SELECT text FROM c)
UNION ALL SELECT 'miss', count(DISTINCT text)::BIGINT, count(DISTINCT text)::BIGINT FROM documents WHERE text NOT IN (SELECT text FROM c)""")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits, misses = index.cache_split(docs, docs.filter("doc_id % 2 = 0").select("text", F.col("doc_id").alias("cached")))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_distinct("text").alias("texts"))
    return count(hits, "hit").unionByName(count(misses, "miss"))


@query("""WITH u AS (SELECT conv_id, turn, conv_id * 1000 + turn AS r, nullif(role, 'system') AS section, text FROM conversations),
k AS (SELECT *, CASE WHEN section IS NULL THEN conv_id || '#ungrouped-' || (row_number() OVER (PARTITION BY section IS NULL ORDER BY r) - 1) ELSE conv_id || '#' || section END AS group_uri FROM u),
g AS (SELECT group_uri, string_agg(text, chr(10) ORDER BY r) AS text, min(r) AS first_row, count(*) AS n_units FROM k GROUP BY group_uri)
SELECT group_uri, text, first_row::BIGINT AS first_row, n_units::BIGINT AS n_units, (row_number() OVER (ORDER BY first_row) - 1)::BIGINT AS doc_id FROM g""")
def group_concat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    units = c.select(F.col("conv_id").alias("doc_uri"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row"), F.nullif("role", F.lit("system")).alias("section"), "text")
    return index.group_concat(units, "section")


# Text


@query(f"SELECT doc_id, len(w)::BIGINT AS n_words, list_distinct(w).len()::BIGINT AS n_distinct, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w FROM documents)")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.try_element_at("w", F.lit(1)).alias("first_word"), F.try_element_at("w", F.lit(-1)).alias("last_word"))


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w, string_split(regexp_replace(text, '{WORD_SQL}', chr(1), 'g'), chr(1)) AS gaps FROM documents),
e AS (SELECT doc_id, i, length(w[i]) AS size, sum(length(gaps[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM d, unnest(range(1, len(w) + 1)) t(i))
SELECT doc_id, count(*)::BIGINT AS n_words, sum(stop - size)::BIGINT AS starts, sum(stop)::BIGINT AS ends, max(stop)::BIGINT AS last_end FROM e GROUP BY doc_id""")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.word_offsets("text").alias("w")).select("doc_id", "w.*").filter(F.size("start") > 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("doc_id", F.size("start").cast("bigint").alias("n_words"), total("start").alias("starts"), total("end").alias("ends"), F.element_at("end", -1).cast("bigint").alias("last_end"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[^{SPACE}]+'))::BIGINT AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").alias("n_tokens"))


@query(f"SELECT doc_id, substring(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 1, 1500) AS snippet FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{T.SENTENCE}'), lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM s, unnest(range(1, len(s) + 1)) t(i)""")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    return each.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


#: Words and what stands between them, put together again, are the text, so the offsets that their lengths add up to are right.
@query(f"""WITH d AS (SELECT text, regexp_extract_all(text, '{WORD_SQL}') AS w, string_split(regexp_replace(text, '{WORD_SQL}', chr(1), 'g'), chr(1)) AS gaps FROM documents)
SELECT sum(len(w))::BIGINT AS n_words, coalesce(sum(len(w)) FILTER (array_to_string(list_transform(list_zip(gaps, w), lambda x: x[1] || coalesce(x[2], '')), '') <> text), 0)::BIGINT AS n_wrong FROM d""")
def offset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("text", F.explode(T.word_spans("text")).alias("w"))
    wrong = F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")) != F.col("w.text")
    return w.agg(F.count("*").alias("n_words"), F.count_if(wrong).alias("n_wrong"))


# Static embedder (stand-in vocabulary) and what is built on it

HASHED = ", ".join(f"(('0x' || substr(md5(token || ':{j // 4}'), {8 * (j % 4) + 1}, 8))::BIGINT % 2001 - 1000) / 1000.0::DOUBLE" for j in range(scorers.DIM))


def _embed_sql(rows: str) -> str:
    """CTEs that embed ``rows`` (key, text) as ``emb`` (key, n_tokens, v)."""
    sums = ", ".join(f"sum(v[{j + 1}] * n)" for j in range(scorers.DIM))
    return f"""b AS ({rows}), k AS (SELECT key, unnest(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS token FROM b), kc AS (SELECT key, token, count(*) AS n FROM k GROUP BY ALL),
kv AS (SELECT token, [{HASHED}] AS v FROM (SELECT DISTINCT token FROM kc)),
ks AS (SELECT key, sum(n) AS n_tokens, [{sums}] AS s FROM kc JOIN kv USING (token) GROUP BY key),
emb AS (SELECT key, coalesce(n_tokens, 0)::BIGINT AS n_tokens, CASE WHEN s IS NULL OR list_inner_product(s, s) = 0 THEN list_transform(range({scorers.DIM}), lambda x: 0.0::DOUBLE)
 ELSE list_transform(s, lambda x: x / sqrt(list_inner_product(s, s))) END AS v FROM (SELECT DISTINCT key FROM b) LEFT JOIN ks USING (key))"""


DOCS_SQL = _embed_sql("SELECT doc_id AS key, text FROM documents")
COS = "CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END"


@query(f"WITH {DOCS_SQL} SELECT key AS doc_id, n_tokens, list_transform(v, lambda x: round(x, 6) + 0.0) AS embedding FROM emb")
def vocab_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorers.vocab_embed(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("embedding", rounded("embedding"))


@query(f"WITH {DOCS_SQL}, q AS (SELECT v AS q FROM emb WHERE key = 0) SELECT key AS doc_id, round({COS.format(a='v', b='q')}, 6) AS score FROM emb, q ORDER BY {COS.format(a='v', b='q')} DESC, key LIMIT 10")
def doc_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = scorers.vocab_embed(docs.filter("doc_id = 0"), ["doc_id"]).select(F.col("embedding").alias("q"))
    return retrieve.top_k(scorers.vocab_embed(docs, ["doc_id"]), asked, k=10).select("doc_id", r6("score").alias("score"))


_SIGNS = ", ".join(f"sum(weight * CASE WHEN ('0x' || substr(md5('bucket:' || bucket), {2 * j + 1}, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)" for j in range(token_table.DIM))
#: CTEs that learn ``tt`` (token, n, vector) from the documents.
TOKEN_SQL = f"""tw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^{SPACE}]+') AS w FROM documents),
tk AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM tw),
tz AS (SELECT token, [lag(token, 2) OVER o, lag(token, 1) OVER o, lead(token, 1) OVER o, lead(token, 2) OVER o] AS near FROM tk WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
tp AS (SELECT token, ('0x' || substr(md5(c), 1, 8))::BIGINT % {token_table.BUCKETS} AS bucket FROM (SELECT token, unnest(near) AS c FROM tz) WHERE c IS NOT NULL),
tc AS (SELECT token, bucket, count(*) AS n FROM tp GROUP BY ALL),
tm AS (SELECT *, greatest(0.0::DOUBLE, ln(n::DOUBLE * sum(n) OVER () / sum(n) OVER (PARTITION BY token) / sum(n) OVER (PARTITION BY bucket))) AS weight FROM tc),
tv AS (SELECT token, [{_SIGNS}] AS v FROM tm GROUP BY token),
tn AS (SELECT token, count(*) AS n FROM tk GROUP BY token HAVING count(*) >= {token_table.LEAST}),
tt AS (SELECT token, n::BIGINT AS n, CASE WHEN v IS NULL OR list_inner_product(v, v) = 0 THEN list_transform(range({token_table.DIM}), lambda x: 0::BIGINT)
 ELSE list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)) * {token_table.SCALE})::BIGINT) END AS vector FROM tn LEFT JOIN tv USING (token))"""


@query(f"WITH {TOKEN_SQL} SELECT token, n, vector FROM tt")
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors learned from all documents."""
    return token_table.learn(table(spark, sf_dir, "documents"))


@query(f"""WITH {TOKEN_SQL}, tx AS (SELECT doc_id, count(token) AS n_tokens, count(*) FILTER (token IS NOT NULL AND vector IS NULL) AS n_unknown, {', '.join(f'coalesce(sum(vector[{j + 1}]), 0) AS x{j}' for j in range(token_table.DIM))}
 FROM documents LEFT JOIN tk USING (doc_id) LEFT JOIN tt USING (token) GROUP BY doc_id), ty AS (SELECT doc_id, n_tokens, n_unknown, [{', '.join(f'x{j}::DOUBLE' for j in range(token_table.DIM))}] AS v FROM tx)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, n_unknown::BIGINT AS n_unknown, list_transform(v, lambda x: round(x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END, 6) + 0.0) AS embedding FROM ty""")
def token_table_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the table learned from all of them; frequent tokens from a broadcast part, the others by a join."""
    docs = table(spark, sf_dir, "documents")
    learned = stored(token_table.learn(docs), "tokens")
    return token_table.embed(docs, learned, ["doc_id"], heavy=4096).withColumn("embedding", rounded("embedding"))


LINES_SQL = f"SELECT (doc_id, i) AS key, string_split(text, chr(10))[i] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)"


@query(f"""WITH RECURSIVE {_embed_sql(LINES_SQL)}, a AS (SELECT key[1] AS parent, key[2] - 1 AS pos, n_tokens AS tokens, v, lag(v) OVER (PARTITION BY key[1] ORDER BY key[2]) AS p FROM emb),
n AS (SELECT parent, pos, pos AS i, tokens, round({COS.format(a='v', b='p')}, 9) AS sim FROM a)""" + PACK_SQL.format(cut="(n.sim < 0.3 OR r.held + n.tokens > 128)"))
def doc_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    units = scorers.vocab_embed(each.withColumn("pos", F.col("pos").cast("bigint")), ["parent", "pos"]).withColumnRenamed("n_tokens", "tokens")
    return chunk.pack(chunk.adjacent_cosine(units, "parent", "pos").withColumn("sim", F.round("sim", 9)), "parent", "pos", max_tokens=128, drop_threshold=0.3)


@query(f"""WITH {_embed_sql(LINES_SQL)}, dd AS (SELECT key[1] AS doc_id, i, avg(v[i]) AS x FROM emb, unnest(range(1, {scorers.DIM + 1})) t(i) GROUP BY ALL),
c AS (SELECT doc_id, list(x ORDER BY i) AS c FROM dd GROUP BY doc_id), s AS (SELECT key[1] AS doc_id, key[2] - 1 AS pos, round({COS.format(a='v', b='c')}, 6) AS score FROM emb JOIN c ON key[1] = doc_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) - 1)::INTEGER AS rank FROM s) SELECT doc_id, pos, score, rank FROM r WHERE rank < 3""")
def doc_extractive_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
    scored = rank.salience(scorers.vocab_embed(each, ["doc_id", "pos"]), "doc_id").withColumn("score", r6("score"))
    return rank.ranked(scored, "doc_id", "pos", 3).select("doc_id", "pos", "score", "rank")


# Pairs

LOGIT_SQL = f"""(SELECT doc_id, 8.0 * len(list_intersect(w, q)) / greatest(len(list_distinct(list_concat(w, q))), 1) - 2.0 AS logit
 FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS w, string_split('{QUESTION}', ' ') AS q FROM documents))"""


@query(f"SELECT doc_id, round(1 / (1 + exp(-logit)), 6) AS rerank_score FROM {LOGIT_SQL} ORDER BY 1 / (1 + exp(-logit)) DESC, doc_id LIMIT 20")
def rerank_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = pairs.rerank(table(spark, sf_dir, "documents"), scorers.lexical_logit(QUESTION, "text"), 20, pos="doc_id")
    return best.select("doc_id", r6("rerank_score").alias("rerank_score"))


@query(f"""WITH {E_}, s AS (SELECT q.vec_id AS query_id, e.vec_id, e.v, list_cosine_similarity(e.v, q.v) AS score FROM e, e q WHERE q.vec_id % 100 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s), g AS (SELECT f.*, 1 / (1 + exp(-4 * list_cosine_similarity(f.v, w.v))) AS again FROM f JOIN e w ON w.vec_id = f.query_id + 1 WHERE n <= 50),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY again DESC, vec_id) - 1)::INTEGER AS rank FROM g)
SELECT query_id, vec_id, round(score, 6) AS score, round(again, 6) AS rerank_score, rank FROM r WHERE rank < 10""")
def retrieve_then_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest rows of each query, ranked anew by a pair scorer that knows the vector after the query's; the best ten."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    first = retrieve.top_k_batch(e, asked, k=50, id_col="vec_id").drop("rank").join(e, "vec_id")
    both = first.join(e.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("q")), "query_id")
    best = rank.reranked(both, "query_id", "vec_id", 4.0 * V.cosine("embedding", "q"), 10, score="rerank_score")
    return best.select("query_id", "vec_id", r6("score").alias("score"), r6("rerank_score").alias("rerank_score"), "rank")


def _nli_logits(text: Column, hypothesis: Column) -> Column:
    n, h = F.length(text), F.length(hypothesis)
    return F.array((n % 7 / 2.0), ((n + h) % 11 / 2.0), (h % 5 / 2.0).cast("double"))


NLI_SQL = "h AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(HYPOTHESES)) + """) t(hyp_pos, hypothesis)),
l AS (SELECT doc_id, hyp_pos, hypothesis, length(text) % 7 / 2.0::DOUBLE AS a, (length(text) + length(hypothesis)) % 11 / 2.0::DOUBLE AS b, length(hypothesis) % 5 / 2.0::DOUBLE AS c FROM documents, h),
p AS (SELECT doc_id, hyp_pos, hypothesis, exp(b - greatest(a, b, c)) / z AS entailment, exp(c - greatest(a, b, c)) / z AS neutral, exp(a - greatest(a, b, c)) / z AS contradiction
 FROM (SELECT *, exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c)) AS z FROM l)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(entailment, 12) DESC, hyp_pos) AS n FROM p) WHERE n = 1)"""


def _nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pairs.nli(table(spark, sf_dir, "documents").select("doc_id", "text"), HYPOTHESES, _nli_logits)
    return scored.withColumn("entailment", F.round("entailment", 12))


@query(f"WITH {NLI_SQL} SELECT doc_id, hypothesis, round(entailment, 6) AS entailment, round(neutral, 6) AS neutral, round(contradiction, 6) AS contradiction FROM p")
def nli_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nli(spark, sf_dir).select("doc_id", "hypothesis", *[r6(c).alias(c) for c in ("entailment", "neutral", "contradiction")])


@query(f"WITH {NLI_SQL} SELECT doc_id, hypothesis, round(entailment, 6) AS entailment FROM best")
def nli_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.best_hypothesis(_nli(spark, sf_dir), "doc_id").withColumn("entailment", r6("entailment"))


@query(f"WITH {NLI_SQL} SELECT hypothesis, count(*)::BIGINT AS n FROM best GROUP BY hypothesis")
def nli_argmax_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.best_hypothesis(_nli(spark, sf_dir), "doc_id").groupBy("hypothesis").agg(F.count("*").alias("n"))


@query(f"""WITH {NLI_SQL} SELECT round(avg(CASE WHEN hypothesis = CASE WHEN contains(lower(text), 'that') THEN '{HYPOTHESES[0]}' WHEN contains(lower(text), 'que') THEN '{HYPOTHESES[1]}' ELSE '{HYPOTHESES[3]}' END
 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, count(*)::BIGINT AS n FROM best JOIN documents USING (doc_id)""")
def nli_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gold = docs.select("doc_id", F.coalesce(pairs.first_keyword(docs, [("that", HYPOTHESES[0]), ("que", HYPOTHESES[1])]), F.lit(HYPOTHESES[3])).alias("gold"))
    both = pairs.best_hypothesis(_nli(spark, sf_dir), "doc_id").join(gold, "doc_id")
    return both.agg(r6(F.avg((F.col("hypothesis") == F.col("gold")).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


# Spans

SPANS_SQL = f"""w AS (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w FROM documents),
s AS (SELECT doc_id, word, width FROM w, unnest(range(0, len(w))) t(word), unnest(range(0, 3)) x(width) WHERE word + width < len(w)),
f AS (SELECT doc_id, word, width, label_pos, [{', '.join(f"'{x}'" for x in LABELS)}][label_pos + 1] AS label, 1 / (1 + exp(-(((doc_id + word * 7 + width * 13 + label_pos * 29) % 41) / 4.0::DOUBLE - 8.7))) AS score
 FROM s, unnest(range(0, 3)) l(label_pos)), g AS (SELECT * FROM f WHERE score >= 0.7)"""


#: Longest span in words and least score of the named queries, and of their ``_w12`` forms: the reference's defaults.
NARROW, WIDE = (3, 0.7), (12, 0.5)


class SpanLogits:
    """Stand-in logits: plain arithmetic over document, word, width and label."""

    def span_logits(self, key: int, text: str, words: np.ndarray, first: int, stop: int, max_width: int, labels: list[str]) -> np.ndarray:
        # (key + 7 word + 13 width + 29 label) mod 41, over 4, less 8.7
        width, label = np.ogrid[0:max_width, 0 : len(labels)]
        begin = (key + np.arange(first, stop) * 7) % 41
        return (np.arange(82) % 41 / 4.0 - 8.7)[begin[:, None, None] + (width * 13 + label * 29) % 41]


def _entities(spark: SparkSession, sf_dir: str, bounds: tuple[int, float], **rules: bool) -> DataFrame:
    """The entities of each document: spans of up to so many words with a stand-in score of so much or more."""
    return spans.extract(table(spark, sf_dir, "documents"), "doc_id", LABELS, SpanLogits, *bounds, **rules)


def _found(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    """All of them, before the walk, a row each."""
    return _entities(spark, sf_dir, bounds, walk=False).select("doc_id", F.inline("entities"))


@query(f"WITH {SPANS_SQL} SELECT doc_id, count(*)::BIGINT AS n_spans, sum(width)::BIGINT AS widths FROM s GROUP BY doc_id")
def span_enumerate(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    each = spans.span_table(table(spark, sf_dir, "documents"), "doc_id", bounds[0]).filter(F.size("word") > 0)
    return each.select("doc_id", F.size("word").cast("bigint").alias("n_spans"), F.aggregate("width", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("widths"))


@query(f"WITH {SPANS_SQL} SELECT doc_id, word::INTEGER AS word, width::INTEGER AS width, label, round(score, 6) AS score FROM g")
def ner_threshold(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return _found(spark, sf_dir, bounds).select("doc_id", "word", "width", "label", r6("score").alias("score"))


@query(f"WITH {SPANS_SQL} SELECT label, count(*)::BIGINT AS n FROM g GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    each = _entities(spark, sf_dir, bounds, walk=False).select(F.explode("entities.label").alias("label"))
    return each.groupBy("label").agg(F.count("*").alias("n"))


def _survivors(spark: SparkSession, sf_dir: str, bounds: tuple[int, float], **rules: bool) -> DataFrame:
    each = _entities(spark, sf_dir, bounds, **rules).select("doc_id", F.inline("entities"))
    return each.select("doc_id", "start", "end", "text", "label", r6("score").alias("score"))


def _greedy_sql(may_stay: str) -> str:
    """The walk over each document's candidates in order: ``r`` has the survivor, and ``g`` what is given out at a step.

    Where a candidate begins behind all before it, the survivor is given out under any rule, so each stretch up to such
    a place is walked by itself, and the recursion takes as many steps as the longest one has candidates.
    """
    return f"""WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w, string_split(regexp_replace(text, '{WORD_SQL}', chr(1), 'g'), chr(1)) AS gaps FROM documents),
o AS (SELECT doc_id, i, sum(length(gaps[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS stop, length(w[i]) AS size FROM x, unnest(range(1, len(w) + 1)) t(i)),
l AS (SELECT doc_id, list(stop - size ORDER BY i) AS bs, list(stop ORDER BY i) AS es FROM o GROUP BY doc_id),
w AS (SELECT doc_id, word, width, bs[word + 1] AS b, es[word + width + 1] AS e FROM l, unnest(range(0, len(bs))) t(word), unnest(range(0, 3)) x(width) WHERE word + width < len(bs)),
f AS (SELECT doc_id, word, width, b, e, label_pos, 1 / (1 + exp(-(((doc_id + word * 7 + width * 13 + label_pos * 29) % 41) / 4.0::DOUBLE - 8.7))) AS score FROM w, unnest(range(0, 3)) l(label_pos)),
q AS (SELECT *, row_number() OVER (ORDER BY doc_id, b, e, word, width, label_pos) AS n FROM f WHERE score >= 0.7),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM q),
d AS (SELECT *, b >= coalesce(furthest, 0) AS begins FROM m),
c AS MATERIALIZED (SELECT n, doc_id, b, e, label_pos, score, begins, coalesce(lead(begins) OVER (ORDER BY n), true) AS ends FROM d),
r AS (SELECT n, doc_id, b, e, label_pos, score, ends, NULL::BIGINT AS gb, NULL::BIGINT AS ge, NULL::BIGINT AS gl, NULL::DOUBLE AS gs FROM c WHERE begins UNION ALL
 SELECT c.n, c.doc_id, CASE WHEN {may_stay} OR r.score < c.score THEN c.b ELSE r.b END, CASE WHEN {may_stay} OR r.score < c.score THEN c.e ELSE r.e END,
 CASE WHEN {may_stay} OR r.score < c.score THEN c.label_pos ELSE r.label_pos END, CASE WHEN {may_stay} OR r.score < c.score THEN c.score ELSE r.score END, c.ends,
 CASE WHEN {may_stay} THEN r.b END, CASE WHEN {may_stay} THEN r.e END, CASE WHEN {may_stay} THEN r.label_pos END, CASE WHEN {may_stay} THEN r.score END
 FROM r JOIN c ON c.n = r.n + 1 WHERE NOT r.ends),
k AS (SELECT doc_id, gb AS b, ge AS e, gl AS label_pos, gs AS score FROM r WHERE gb IS NOT NULL UNION ALL SELECT doc_id, b, e, label_pos, score FROM r WHERE ends)
SELECT doc_id, b::INTEGER AS start, e::INTEGER AS "end", substring(text, b + 1, e - b) AS text, [{', '.join(f"'{x}'" for x in LABELS)}][label_pos + 1] AS label, round(score, 6) AS score FROM k JOIN documents USING (doc_id)"""


APART = "(c.b >= r.e OR r.b >= c.e)"


@query(_greedy_sql(APART))
def ner_greedy_flat(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return _survivors(spark, sf_dir, bounds)


@query(_greedy_sql(f"({APART} OR c.label_pos <> r.label_pos)"))
def ner_greedy_multi(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return _survivors(spark, sf_dir, bounds, flat=False, multi_label=True)


BIO_SQL = f"""k AS (SELECT doc_id, i - 1 AS pos FROM documents, unnest(range(1, len(regexp_extract_all(text, '{WORD_SQL}')) + 1)) t(i)),
l AS (SELECT doc_id, pos, [{', '.join(f'((pos * {7 * (j + 3)} + doc_id * 11 + {j * 5}) % 23) / 3.0::DOUBLE' for j in range(5))}] AS x FROM k),
p AS (SELECT doc_id, pos, list_position(x, list_max(x)) AS best, 1 / list_sum(list_transform(x, lambda y: exp(y - list_max(x)))) AS prob FROM l),
b AS (SELECT doc_id, pos, [{', '.join(f"'{x}'" for x in BIO)}][best] AS label, prob FROM p),
c AS (SELECT *, CASE WHEN label = 'O' THEN NULL ELSE substring(label, 3) END AS cat FROM b),
d AS (SELECT *, CASE WHEN cat IS NULL OR (label LIKE 'I-%' AND lag(cat) OVER (PARTITION BY doc_id ORDER BY pos) = cat) THEN 0 ELSE 1 END AS begins FROM c),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM d),
o AS (SELECT doc_id, any_value(cat) AS label, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos, min(prob) AS score FROM g WHERE cat IS NOT NULL GROUP BY doc_id, span)"""


class TagLogits:
    """Stand-in logits of each word: plain arithmetic over document and place."""

    def tag_logits(self, key: int, text: str, words: np.ndarray) -> np.ndarray:
        pos, label = np.ogrid[0 : len(words), 0 : len(BIO)]
        return (pos * (7 * (label + 3)) + key * 11 + label * 5) % 23 / 3.0


def _bio(spark: SparkSession, sf_dir: str, threshold: float = 0.0) -> DataFrame:
    found = spans.tag_spans(table(spark, sf_dir, "documents"), "doc_id", BIO, TagLogits, threshold).select("doc_id", F.inline("spans"))
    return found.select("doc_id", "label", "first_pos", "last_pos", r6("score").alias("score"))


@query(f"WITH {BIO_SQL} SELECT doc_id, pos::INTEGER AS pos, label, round(prob, 6) AS prob FROM b")
def bio_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = spans.tag_words(table(spark, sf_dir, "documents"), "doc_id", BIO, TagLogits).select("doc_id", F.posexplode(F.arrays_zip("place", "prob")).alias("pos", "w"))
    label = F.element_at(F.array(*[F.lit(x) for x in BIO]), F.col("w.place") + 1)
    return each.select("doc_id", "pos", label.alias("label"), r6("w.prob").alias("prob"))


@query(f"WITH {BIO_SQL} SELECT doc_id, label, first_pos, last_pos, round(score, 6) AS score FROM o")
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bio(spark, sf_dir)


@query(f"WITH {BIO_SQL} SELECT doc_id, label, first_pos, last_pos, round(score, 6) AS score FROM o WHERE score >= 0.5")
def pii_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bio(spark, sf_dir, 0.5)


@query(f"WITH {BIO_SQL} SELECT DISTINCT cat AS category FROM c WHERE cat IS NOT NULL")
def pii_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that occur among the tagged words of all documents."""
    tagged = spans.tag_words(table(spark, sf_dir, "documents"), "doc_id", BIO, TagLogits).select(F.explode(F.array_distinct("place")).alias("place"))
    return spans.span_labels(tagged.select(F.element_at(F.array(*[F.lit(x) for x in BIO]), F.col("place") + 1).alias("label")))


# Evaluation

def _norm_sql(c: str) -> str:
    return f"""regexp_replace(lower(regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '^[,.;:"''() ]+|[,.;:"''() ]+$', '', 'g')"""


#: Gold are the benchmark's items, predictions whole documents; one may hold the other.
GOLD_SQL = f"""gold AS (SELECT item_id, {_norm_sql("text")} AS g FROM benchmark), pred AS (SELECT doc_id, {_norm_sql("text")} AS p FROM documents),
hit AS (SELECT DISTINCT g, p FROM (SELECT DISTINCT g FROM gold WHERE g <> '') JOIN (SELECT DISTINCT p FROM pred WHERE p <> '') ON contains(g, p) OR contains(p, g))"""


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold, predictions, and the pairs that match."""
    gold = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    pred = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pred"))
    return gold, pred, contain.either_way(gold, pred)


@query(f"WITH {GOLD_SQL} SELECT count(*)::BIGINT AS n_gold, count(*) FILTER (g IN (SELECT g FROM hit))::BIGINT AS n_hit, round(count(*) FILTER (g IN (SELECT g FROM hit))::DOUBLE / count(*), 6) AS recall FROM gold")
def gold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _, pairs_ = _gold(spark, sf_dir)
    counts = contain.matched(gold, pairs_, "gold", "g").agg(F.count("*").alias("n_gold"), F.count_if("matched").alias("n_hit"))
    return counts.withColumn("recall", r6(evaluate.ratio(F.col("n_hit"), F.col("n_gold"))))


@query(f"WITH {GOLD_SQL} SELECT item_id FROM gold WHERE g NOT IN (SELECT g FROM hit)")
def gold_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _, pairs_ = _gold(spark, sf_dir)
    return contain.matched(gold, pairs_, "gold", "g").filter("NOT matched").select("item_id")


@query(f"WITH {GOLD_SQL} SELECT count(*)::BIGINT AS n_pred, count(*) FILTER (p IN (SELECT p FROM hit))::BIGINT AS n_matched, round(count(*) FILTER (p IN (SELECT p FROM hit))::DOUBLE / count(*), 6) AS precision FROM pred")
def gold_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pred, pairs_ = _gold(spark, sf_dir)
    counts = contain.matched(pred, pairs_, "pred", "p").agg(F.count("*").alias("n_pred"), F.count_if("matched").alias("n_matched"))
    return counts.withColumn("precision", r6(evaluate.ratio(F.col("n_matched"), F.col("n_pred"))))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "string")
    pairs_ = contain.containing(docs, items)
    return pairs_.join(items.select("string", "item_id"), "string").join(docs.select("doc_id", "text"), "text").select("doc_id", "item_id")


#: Words of the benchmark that are looked for in documents: the longest of each item, the first of equals.
RULES_SQL = f"""rules AS (SELECT item_id, (list_sort(list_transform(regexp_extract_all(lower(text), '[^{SPACE}]+'), lambda x, i: [-length(x), i]))[1])[2] AS i, regexp_extract_all(lower(text), '[^{SPACE}]+') AS w FROM benchmark),
k AS (SELECT item_id, w[i] AS string FROM rules)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.white_space_words(F.lower("text"))
    longest = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.get(longest, F.lit(0))["w"].alias("string"))


@query(f"WITH {RULES_SQL} SELECT d.doc_id, min(k.item_id) AS item_id FROM documents d LEFT JOIN k ON contains(lower(d.text), k.string) GROUP BY d.doc_id")
def first_keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of the benchmark of which a document holds the longest word; null for none."""
    rules = _rules(spark, sf_dir)
    return contain.first_match(table(spark, sf_dir, "documents"), "doc_id", rules, priority="item_id", value="item_id")


@query(f"""WITH {RULES_SQL}, f AS (SELECT d.doc_id, min(k.item_id) AS item_id FROM documents d LEFT JOIN k ON contains(lower(d.text), k.string) GROUP BY d.doc_id)
SELECT quality, count(*)::BIGINT AS n, round(avg(CASE WHEN (item_id IS NOT NULL) = (quality = 1) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM labels JOIN f USING (doc_id) GROUP BY quality""")
def keyword_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a keyword of the benchmark tells good documents by ``labels``, for either label."""
    both = table(spark, sf_dir, "labels").join(first_keyword_match(spark, sf_dir), "doc_id")
    right = (F.col("item_id").isNotNull() == (F.col("quality") == 1)).cast("double")
    return both.groupBy("quality").agg(F.count("*").alias("n"), r6(F.avg(right)).alias("accuracy"))


@query(f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS q FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS w FROM documents),
s AS (SELECT item_id, doc_id, 1 / (1 + exp(-(8.0 * len(list_intersect(w, q)) / greatest(len(q) + len(w) - len(list_intersect(w, q)), 1) - 2.0))) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s) SELECT item_id, doc_id, round(score, 6) AS rerank_score, rank::INTEGER AS rank FROM r WHERE rank < 10""")
def rerank_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest to each item of the benchmark by a pair scorer."""
    best = pairs.rerank_each(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scorers.LexicalPairs, 10, "item_id", "text")
    return best.select("item_id", "doc_id", r6("rerank_score").alias("rerank_score"), "rank")


COUNTS_SQL = f"WITH {SPANS_SQL}, n AS (SELECT d.doc_id, count(g.doc_id) AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id)"


def _per_doc(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return _entities(spark, sf_dir, bounds, walk=False).select("doc_id", F.size("entities").cast("bigint").alias("n"))


@query(COUNTS_SQL + " SELECT count(*)::BIGINT AS n, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, max(n)::DOUBLE AS max FROM n")
def entities_per_doc_stats(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return evaluate.order_statistics(_per_doc(spark, sf_dir, bounds), "n").select("n", r6("mean").alias("mean"), "median", "max")


@query(COUNTS_SQL + """, r AS (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS t FROM n)
SELECT round(max(n) FILTER (k = (t + 1) * 19 // 20) + (max(n) FILTER (k = (t + 1) * 19 // 20 + 1) - max(n) FILTER (k = (t + 1) * 19 // 20)) * (((t + 1) * 19 % 20) / 20.0::DOUBLE), 6)::DOUBLE AS p95 FROM r GROUP BY t""")
def p95_exclusive(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return evaluate.order_statistics(_per_doc(spark, sf_dir, bounds), "n").select(r6("p95_exclusive").alias("p95"))


@query(COUNTS_SQL + """, r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS t FROM n)
SELECT max(n) FILTER (k = t // 2)::DOUBLE AS p50, max(n) FILTER (k = least(t - 1, t * 19 // 20))::DOUBLE AS p95 FROM r""")
def p95_nearest_rank(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return evaluate.order_statistics(_per_doc(spark, sf_dir, bounds), "n").select("p50", "p95")


@query(COUNTS_SQL + " SELECT doc_id FROM n WHERE n = 0")
def zero_entity_docs(spark: SparkSession, sf_dir: str, bounds: tuple[int, float] = NARROW) -> DataFrame:
    return _per_doc(spark, sf_dir, bounds).filter("n = 0").select("doc_id")


WIDE_SQL = SPANS_SQL.replace("range(0, 3)) x(width)", f"range(0, {WIDE[0]})) x(width)").replace("score >= 0.7", f"score >= {WIDE[1]}")
for _narrow in (
    span_enumerate, ner_threshold, label_distribution, ner_greedy_flat, ner_greedy_multi, entities_per_doc_stats, p95_exclusive, p95_nearest_rank,
    zero_entity_docs,
):
    QUERIES[f"{_narrow.__name__}_w{WIDE[0]}"] = functools.partial(_narrow, bounds=WIDE)
    # Wide spans hang together over whole documents, where the recursion takes a step a candidate; that form is tested on a small fixture.
    if _narrow.__name__ in SQL and "greedy" not in _narrow.__name__:
        SQL[f"{_narrow.__name__}_w{WIDE[0]}"] = SQL[_narrow.__name__].replace(SPANS_SQL, WIDE_SQL)


#: Sources of the documents play the models: by language, with a revision; some are excluded, some in neither list.
REGISTRY_SQL = """reg AS (SELECT DISTINCT lang AS family, source AS model_id, CASE WHEN length(source) = 4 THEN sha1(source) ELSE 'main' END AS revision FROM documents WHERE source NOT LIKE '%3' AND source NOT LIKE '%7'),
exc AS (SELECT DISTINCT lang AS family, source AS model_id, 'licence ' || source AS reason FROM documents WHERE source LIKE '%3')"""


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("family"), F.col("source").alias("model_id")).distinct()
    revision = F.when(F.length("model_id") == 4, F.sha1(F.col("model_id").cast("binary"))).otherwise("main")
    known = docs.filter(~F.col("model_id").endswith("3") & ~F.col("model_id").endswith("7")).withColumn("revision", revision)
    return known, docs.filter(F.col("model_id").endswith("3")).withColumn("reason", F.concat(F.lit("licence "), "model_id"))


@query(f"""WITH {REGISTRY_SQL}, q AS (SELECT DISTINCT source AS model_id FROM documents), e AS (SELECT DISTINCT model_id, reason FROM exc), r AS (SELECT DISTINCT model_id, 1 AS known FROM reg)
SELECT model_id, CASE WHEN reason IS NOT NULL THEN 'excluded: ' || reason WHEN known = 1 THEN 'registered' ELSE 'unknown' END AS status FROM q LEFT JOIN e USING (model_id) LEFT JOIN r USING (model_id)""")
def registry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, out = _registry(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias("model_id")).distinct()
    return evaluate.registry_gate(asked, known.select("model_id").distinct(), out.select("model_id", "reason").distinct())


@query(f"WITH {REGISTRY_SQL} SELECT family, model_id, 'registered' AS kind FROM reg UNION ALL SELECT family, model_id, 'excluded' FROM exc")
def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, out = _registry(spark, sf_dir)
    return known.select("family", "model_id", F.lit("registered").alias("kind")).unionByName(out.select("family", "model_id", F.lit("excluded").alias("kind"))).orderBy("family", "model_id")


@query(f"WITH {REGISTRY_SQL} SELECT family, model_id, regexp_full_match(revision, '[0-9a-f]{{40}}') AS pinned FROM reg")
def revision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir)[0].select("family", "model_id", F.col("revision").rlike("^[0-9a-f]{40}$").alias("pinned"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[^{SPACE}]+'))::BIGINT AS n_tokens,
 substring(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), 1, 80) AS snippet FROM documents""")
def stream_append_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.streaming import index_stream

    return index_stream.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    from textloom.plans import more  # noqa: F401  its queries add themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
