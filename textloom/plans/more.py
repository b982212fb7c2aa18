"""Further named queries: sources and sinks, segments and chunks with their texts, checks and totals."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scorers, sql, tokens
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import batches, chunk, evaluate, pairs, rank
from textloom.operators.cache import EmbeddingCache
from textloom.operators.numbering import numbered, shared_folder
from textloom.plans import catalog as C
from textloom.plans.catalog import query, r6, table
from textloom.sources import documents as D
from textloom.sources.matrices import Matrices
from textloom.streaming import index_stream

TOKENIZER, SPECIALS = "/opt/tokenizers/word_bpe_49k.json", (49406, 49407)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid4()}"


# Sources and sinks


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_id, doc_id AS place, length(text)::BIGINT AS n FROM documents")
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.from_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), "text"), order=["place"])
    return rows.select("doc_id", "place", F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, text, source AS external_id, lang FROM documents")
def source_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("more", F.create_map(F.lit("lang"), F.col("lang")))
    rows = D.from_collection(docs, external_id="source", metadata="more")
    return rows.select("doc_id", "text", "external_id", F.col("metadata")["lang"].alias("lang"))


@query("""SELECT text, CASE WHEN doc_id % 2 = 0 THEN row_number() OVER (ORDER BY doc_id) - 1 ELSE doc_id END::BIGINT AS doc_id,
 CASE WHEN doc_id % 2 = 1 THEN source END AS external_id, CASE WHEN doc_id % 2 = 1 THEN lang END AS lang FROM documents""")
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.to_json(F.struct("text", "doc_id", F.col("source").alias("external_id"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata")))
    alone = F.to_json(F.struct("text"))
    item = F.when(F.col("doc_id") % 2 == 0, F.substring(alone, F.lit(9), F.length(alone) - 9)).otherwise(whole)
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), item.alias("item"))
    return D.documents(items, order=["place"]).select("text", "doc_id", "external_id", F.try_element_at("metadata", F.lit("lang")).alias("lang"))


def _mixed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for each document, of which one in two is bad in one of six ways."""
    whole = F.to_json(F.struct("text", "doc_id", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata")))
    k = F.col("doc_id") % 12
    item = F.when(k == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(k == 1, F.col("n_chars").cast("string")).when(k == 2, F.to_json(F.struct("doc_id")))
    item = item.when(k == 3, F.to_json(F.struct(F.col("n_chars").alias("text")))).when(k == 4, F.to_json(F.struct("text", F.col("source").alias("doc_id"))))
    item = item.when(k == 5, F.to_json(F.struct("text", F.col("source").alias("metadata")))).when(k == 6, F.to_json(F.struct("text"))).otherwise(whole)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("at"), item.alias("item"))


@query("""SELECT text, CASE WHEN doc_id % 12 = 6 THEN place ELSE doc_id END::BIGINT AS doc_id, CASE WHEN doc_id % 12 <> 6 THEN lang END AS lang
 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) WHERE doc_id % 12 >= 6""")
def source_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = D.checked(_mixed_items(spark, sf_dir), order=["at"])
    return good.select("text", "doc_id", F.try_element_at("metadata", F.lit("lang")).alias("lang"))


@query("""SELECT place::BIGINT AS place, ['item', 'item', 'text', 'text', 'doc_id', 'metadata'][doc_id % 12 + 1] AS field,
 ['malformed', 'found BIGINT', 'found VOID', 'found BIGINT', 'found STRING', 'found STRING'][doc_id % 12 + 1] AS reason
 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) WHERE doc_id % 12 < 6""")
def source_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the bad items among the documents are, and what is wrong with them."""
    return D.checked(_mixed_items(spark, sf_dir), order=["at"])[1].select("place", "field", "reason")


@query("SELECT doc_id::VARCHAR AS doc_id, (doc_id % 3) / 2.0::DOUBLE AS score, source AS external_id, lang, 1::BIGINT AS n_metadata FROM documents")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.create_map(F.lit("lang"), F.col("lang"), F.lit("external_id"), F.lit("old"))
    item = F.to_json(F.struct("text", "doc_id", F.col("source").alias("external_id"), (F.col("doc_id") % 3 / 2.0).alias("score"), more.alias("metadata")))
    rows = D.external_ids(D.candidates(table(spark, sf_dir, "documents").select(item.alias("item"))))
    return rows.select("doc_id", "score", "external_id", F.col("metadata")["lang"].alias("lang"), F.size("metadata").cast("bigint").alias("n_metadata"))


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE text END AS text FROM documents")
def jsonl_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.when(F.col("doc_id") % 4 == k, F.col("text")).otherwise(F.when(F.col("doc_id") % 4 > k, F.lit("")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), at(0).alias("text"), at(1).alias("content"), at(2).alias("body"))
    path = _folder(spark)
    rows.write.json(path)
    return D.corpus_lines(spark, path)


@query(f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark), t AS (SELECT regexp_replace(line, '^[{C.SPACE}]+|[{C.SPACE}]+$', '', 'g') AS sentence FROM l)
SELECT sentence FROM t WHERE sentence <> ''""")
def sentence_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return D.sentence_lines(spark, path)


@query("SELECT vec_id, len(embedding)::INTEGER AS dim, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    D.write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dim"), r6(V.norm("embedding")).alias("norm"))


@query("SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings")
def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written as matrix files by all tasks, and read again by ranges of rows."""
    spark.dataSource.register(Matrices)
    path = _folder(spark).removeprefix("file:")
    table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<float>").alias("vector")).write.format("matrix").mode("append").save(path)
    return spark.read.format("matrix").option("rows", 500).load(path).select(F.col("row").alias("vec_id"), F.col("vector").cast("array<double>").alias("embedding"))


@query("SELECT lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    D.write_report(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return spark.read.schema("lang string, n bigint, chars bigint").json(path)


@query("SELECT (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS class, lang AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def config_label_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of the documents, numbered in a model's config that is written and read again."""
    path = _folder(spark)
    # A row for each language.
    langs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").groupBy().agg(F.array_sort(F.collect_set("lang")).alias("l"))
    numbered_ = F.map_from_arrays(F.transform("l", lambda _, i: i.cast("string")), F.col("l"))
    langs.select(F.to_json(F.struct(numbered_.alias("id2label"))).alias("value")).coalesce(1).write.text(path)
    return D.config_labels(spark, path)


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def sample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(50)


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS embedded, 0::BIGINT AS embedded_again, count(DISTINCT text)::BIGINT AS kept FROM documents")
def lasting_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded through a cache on disk, twice: how many texts the first and the second run embed, and how many it holds."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), _folder(spark)
    embed = lambda texts: scorers.vocab_embed(texts, ["digest"])
    first = EmbeddingCache(spark, path, "hash-vocab", "1").embed(docs, embed)
    rows, again = EmbeddingCache(spark, path, "hash-vocab", "1").embed(docs, embed)
    left = EmbeddingCache(spark, path, "hash-vocab", "1").known().count()
    total = rows.filter("embedding IS NOT NULL").agg(F.count("*").alias("n"))
    return total.select("n", *[F.lit(x).cast("bigint").alias(c) for c, x in (("embedded", first[1]), ("embedded_again", again), ("kept", left))])


@query("""SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def stream_events_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_stream.run_events(spark, sf_dir)
    return rows.select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


# Segments and chunks with their texts

#: Non-blank lines of each document, trimmed, with offsets in a text whose line feeds are ``gap`` characters.
UNITS_SQL = """l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
ln AS (SELECT doc_id, i, line, sum(length(line) + {gap}) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - {gap} AS begin, length(line) - length(regexp_replace(line, '^[{space}]+', '')) AS lead,
 regexp_replace(line, '^[{space}]+|[{space}]+$', '', 'g') AS own FROM l),
un AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, begin + lead AS start, begin + lead + length(own) AS stop, own AS text FROM ln WHERE own <> '')"""


@query(f"WITH {UNITS_SQL.format(gap=2, space=C.SPACE)} SELECT doc_id, pos::BIGINT AS pos, start::INTEGER AS start, stop::INTEGER AS \"end\", text FROM un")
def paragraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The documents have no blank lines, so each line is made a paragraph.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunk.segments(docs, "doc_id", "paragraph")


#: Sentences, trimmed, with offsets: the pattern's matches and what stands between them.
SENTENCES_SQL = f"""sm AS (SELECT doc_id, regexp_extract_all(text, '{T.SENTENCE}') AS w, string_split(regexp_replace(text, '{T.SENTENCE}', chr(1), 'g'), chr(1)) AS gaps FROM documents),
se AS (SELECT doc_id, i, w[i] AS line, sum(length(gaps[i]) + length(w[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(w[i]) AS begin FROM sm, unnest(range(1, len(w) + 1)) t(i)),
sn AS (SELECT *, length(line) - length(regexp_replace(line, '^[{C.SPACE}]+', '')) AS lead, regexp_replace(line, '^[{C.SPACE}]+|[{C.SPACE}]+$', '', 'g') AS own FROM se),
un AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, begin + lead AS start, begin + lead + length(own) AS stop, own AS text FROM sn WHERE own <> '')"""


def _chunks_sql(units: str, text: str) -> str:
    """Chunks of the units ``un`` of the documents' ``text``."""
    return f"""WITH RECURSIVE {units}, {C._embed_sql("SELECT (doc_id, pos) AS key, text FROM un")},
a AS (SELECT key[1] AS parent, key[2] AS pos, n_tokens AS tokens, v, lag(v) OVER (PARTITION BY key[1] ORDER BY key[2]) AS p FROM emb),
n AS (SELECT parent, pos, pos AS i, tokens, round({C.COS.format(a='v', b='p')}, 9) AS sim FROM a)""" + C.PACK_SQL.format(cut="(n.sim < 0.3 OR r.held + n.tokens > 128)").split("\nSELECT parent, chunk")[0] + f""",
z AS (SELECT r.parent AS doc_id, chunk, sum(r.tokens)::BIGINT AS tokens, min(start)::BIGINT AS b, max(stop)::BIGINT AS e, list(r.i::INTEGER ORDER BY r.i) AS unit_indices
 FROM r JOIN un ON un.doc_id = r.parent AND un.pos = r.pos GROUP BY r.parent, chunk), y AS (SELECT z.*, substring({text}, b + 1, e - b) AS text FROM z JOIN documents d USING (doc_id))
SELECT doc_id, chunk, tokens, unit_indices, b AS start, e AS "end", text, sha256(doc_id || '|' || b || '|' || e || '|' || text) AS chunk_id FROM y"""


def _chunked(docs: DataFrame, granularity: str) -> DataFrame:
    units = chunk.segments(docs, "doc_id", granularity)
    # One pass cuts the units; they are embedded from their own texts and joined by number.
    vectors = scorers.vocab_embed(units, ["doc_id", "pos", "start", "end"]).withColumnRenamed("n_tokens", "tokens")
    near = chunk.adjacent_cosine(vectors, "doc_id", "pos").withColumn("sim", F.round("sim", 9))
    out = chunk.chunks(near, docs, "doc_id", max_tokens=128, drop_threshold=0.3)
    return out.select("doc_id", "chunk", "tokens", "unit_indices", "start", "end", "text", "chunk_id")


@query(_chunks_sql(UNITS_SQL.format(gap=1, space=C.SPACE), "d.text"))
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), "line")


@query(_chunks_sql(SENTENCES_SQL, "d.text"))
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), "sentence")


@query(_chunks_sql(UNITS_SQL.format(gap=2, space=C.SPACE), "replace(d.text, chr(10), chr(10) || chr(10))"))
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The documents have no blank lines, so each line is made a paragraph.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return _chunked(docs, "paragraph")


def _view(df: DataFrame) -> str:
    """The name of a view of ``df``, for SQL text."""
    name = f"v{uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, pos::BIGINT AS pos, start::INTEGER AS start, stop::INTEGER AS \"end\", text FROM un")
def sql_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    docs = _view(table(spark, sf_dir, "documents"))
    return spark.sql(f"SELECT d.doc_id, s.pos, s.start, s.end, s.text FROM {docs} d, LATERAL text_segments(d.text, 'sentence') s")


@query(C.SQL["budget_pack"].replace("list(i::INTEGER ORDER BY i) AS unit_indices", "count(*)::INTEGER AS n_units").replace("SELECT parent, chunk,", "SELECT parent, chunk::INTEGER AS chunk,"))
def sql_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    docs = _view(table(spark, sf_dir, "documents"))
    units = f"SELECT doc_id AS parent, CAST(pos AS BIGINT) AS pos, CAST(size(regexp_extract_all(line, r'(?U)(\\S+)', 1)) AS BIGINT) AS tokens, CAST(NULL AS DOUBLE) AS sim FROM {docs} LATERAL VIEW posexplode(split(text, '\\n')) l AS pos, line"
    return spark.sql(f"SELECT * FROM pack_units(TABLE({units}) PARTITION BY parent ORDER BY (pos), 64, CAST(0 AS DOUBLE))")


@query("""WITH RECURSIVE l AS (SELECT doc_id AS parent, i - 1 AS i, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
n AS (SELECT parent, i, i AS pos, len(regexp_extract_all(line, '[^""" + C.SPACE + """]+')) AS tokens FROM l)"""
    + C.PACK_SQL.format(cut="(r.held + n.tokens > 64)").replace("\nSELECT parent, chunk,", ", k AS (SELECT parent, chunk,")
    + """) SELECT count(DISTINCT parent)::BIGINT AS n_docs, count(*)::BIGINT AS n_chunks, max(tokens)::BIGINT AS max_tokens, round(avg(tokens), 6) AS mean_tokens,
 round(count(*)::DOUBLE / count(DISTINCT parent), 6) AS mean_chunks FROM k""")
def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.chunk_metrics(C.budget_pack(spark, sf_dir), "parent")
    return found.select("n_docs", "n_chunks", "max_tokens", r6("mean_tokens").alias("mean_tokens"), r6("mean_chunks").alias("mean_chunks"))


@query(f"""WITH b AS ({C.LINES_SQL}), w AS (SELECT key[1] AS doc_id, key[2] - 1 AS pos, list_distinct(regexp_extract_all(lower(text), '[^{C.SPACE}]+')) AS w, string_split('{C.QUESTION}', ' ') AS q FROM b),
s AS (SELECT doc_id, pos, 1 / (1 + exp(-(8.0 * len(list_intersect(w, q)) / greatest(len(list_distinct(list_concat(w, q))), 1) - 2.0))) AS score FROM w),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) - 1)::INTEGER AS rank FROM s) SELECT doc_id, pos, round(score, 6) AS score, rank FROM r WHERE rank < 3""")
def doc_rerank_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
    best = rank.reranked(each, "doc_id", "pos", scorers.lexical_logit(C.QUESTION, "text"), 3, diversify=0.5)
    return best.select("doc_id", "pos", r6("score").alias("score"), "rank")


# Micro-batches


@query(f"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[^{C.SPACE}]+'))::BIGINT AS n FROM documents),
a AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch, n FROM n), b AS (SELECT greatest(ceil(n / 16.0), 1)::BIGINT * 16 AS band, n, doc_id FROM n),
c AS (SELECT band, n, (row_number() OVER (PARTITION BY band ORDER BY n, doc_id) - 1) // greatest(4096 // band, 1) AS batch FROM b),
p AS (SELECT 'arrival' AS layout, sum(n) AS t, count(*) * max(n) AS p FROM a GROUP BY batch UNION ALL SELECT 'length', sum(n), count(*) * max(n) FROM c GROUP BY band, batch)
SELECT layout, count(*)::BIGINT AS n_batches, sum(t)::BIGINT AS tokens, sum(p)::BIGINT AS padded, round(1 - sum(t)::DOUBLE / sum(p), 6) AS share FROM p GROUP BY layout""")
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what a model would see is padding: 32 documents at a time as they come, and batches by length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").alias("n_tokens"))
    arrival = numbered(rows, ["doc_id"], "n").withColumn("batch", F.floor(F.col("n") / 32))
    one, other = batches.padding(arrival, ["batch"]), batches.padding(batches.length_batches(rows, "doc_id"), ["band", "batch"])
    both = one.withColumn("layout", F.lit("arrival")).unionByName(other.withColumn("layout", F.lit("length")))
    return both.select("layout", "n_batches", "tokens", "padded", r6("share").alias("share"))


# Checks and totals


@query(f"WITH {C.BIO_SQL} SELECT doc_id, label, first_pos, last_pos FROM o WHERE label IN ('PERSON', 'PLACE')")
def label_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._bio(spark, sf_dir).filter(F.col("label").isin("PERSON", "PLACE")).select("doc_id", "label", "first_pos", "last_pos")


@query("SELECT doc_id, gold FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'by [*] of ' || source ELSE source END AS gold FROM documents) WHERE NOT contains(gold, '[*]')")
def redaction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("by [*] of "), "source")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", gold.alias("gold")).filter(evaluate.not_redacted(F.col("gold")))


@query(f"""WITH {C.NLI_SQL}, x AS (SELECT doc_id, hypothesis, round(entailment, 12) + CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE 0 END AS entailment, neutral, contradiction FROM p)
SELECT doc_id, hypothesis, round(entailment, 6) AS entailment FROM x WHERE entailment > 1 OR entailment < 0 OR neutral NOT BETWEEN 0 AND 1 OR contradiction NOT BETWEEN 0 AND 1
 OR entailment + neutral + contradiction NOT BETWEEN 0.99 AND 1.01""")
def invalid_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = C._nli(spark, sf_dir).withColumn("entailment", F.col("entailment") + F.when(F.col("doc_id") % 10 == 0, 0.5).otherwise(0.0))
    return evaluate.invalid_probabilities(off, ["entailment", "neutral", "contradiction"]).select("doc_id", "hypothesis", r6("entailment").alias("entailment"))


@query(f"WITH {C.NLI_SQL} SELECT doc_id, hypothesis, round(entailment, 6) AS entailment, (row_number() OVER (PARTITION BY doc_id ORDER BY round(entailment, 12) DESC, hyp_pos) - 1)::INTEGER AS rank FROM p")
def nli_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.ranked_hypotheses(C._nli(spark, sf_dir), "doc_id").select("doc_id", "hypothesis", r6("entailment").alias("entailment"), "rank")


@query(f"WITH {C.SPANS_SQL}, n AS (SELECT d.doc_id, count(g.doc_id) AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id) "
    "SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_entities, count(*) FILTER (n > 0)::BIGINT AS n_ok, count(*) FILTER (n = 0)::BIGINT AS n_failed FROM n")
def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.entity_totals(C._per_doc(spark, sf_dir), "n")


@query(f"WITH {C.U_}, f AS (SELECT vec_id, list_transform(v, lambda x: round(x, 2)) AS w FROM u) SELECT count(*)::BIGINT AS n, round(min(list_cosine_similarity(v, w)), 6) AS least FROM u JOIN f USING (vec_id)")
def reference_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.unit("embedding").alias("embedding"))
    coarse = rows.select("vec_id", F.transform("embedding", lambda x: F.round(x, 2)).alias("embedding"))
    return evaluate.least_cosine(rows, coarse, "vec_id").withColumn("least", r6("least"))


@query(f"WITH {C.REGISTRY_SQL} SELECT count(*)::BIGINT AS n_both, count(*) = 0 AS disjoint FROM (SELECT model_id FROM reg INTERSECT SELECT model_id FROM exc)")
def registry_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.disjoint(*C._registry(spark, sf_dir))


@query("SELECT count(text)::BIGINT AS n, count(DISTINCT text)::BIGINT AS n_distinct, count(text) = count(DISTINCT text) AS all_distinct FROM documents")
def distinct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distinctness(table(spark, sf_dir, "documents"), "text")


@query("SELECT doc_id, translate(lower(source || '/V-' || lang || '.1'), '/-.', '___') AS slug FROM documents")
def source_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat("source", F.lit("/V-"), "lang", F.lit(".1"))
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(named).alias("slug"))


PROMPT_SQL = "[" + ", ".join(f"'<<ENT>>', '{x}'" for x in C.LABELS) + ", '<<SEP>>']"


@query(f"SELECT doc_id, len(p)::BIGINT AS n, sha256(list_aggregate(p, 'string_agg', ' ')) AS sha FROM (SELECT doc_id, list_concat({PROMPT_SQL}, regexp_extract_all(text, '{C.WORD_SQL}')) AS p FROM documents)")
def entity_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", tokens.entity_prompt(C.LABELS, T.words("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("n"), F.sha2(F.array_join("p", " "), 256).alias("sha"))


# Model tokens. SQL has no tokenizer; tests hold these against the tokenizer itself.


@query()
def model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are not padding, with specials, after truncation to 512, and the numbering of their words."""
    e = table(spark, sf_dir, "documents").select("doc_id", tokens.encode(TOKENIZER, 512, SPECIALS)(F.col("text")).alias("e"))
    total = F.aggregate("e.attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return e.select("doc_id", total.alias("n_tokens"), F.array_max(tokens.words_mask(F.col("e.word_ids"))).alias("n_words"), F.sha2(F.array_join("e.input_ids", ","), 256).alias("ids_sha256"))


@query()
def pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document after one question, as a pair that fits into 128 tokens, filled up to them."""
    e = table(spark, sf_dir, "documents").select("doc_id", tokens.encode(TOKENIZER, 128, SPECIALS, places=False)(F.lit(C.QUESTION), F.coalesce("text", F.lit(""))).alias("e"))
    ids = tokens.padded(F.col("e.input_ids"), F.lit(128))
    return e.select("doc_id", F.size("e.input_ids").alias("n_tokens"), F.size(F.filter("e.type_ids", lambda t: t == 1)).alias("n_second"), F.size(ids).alias("n_padded"), F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"))
