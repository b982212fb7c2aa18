"""Source divergence audit: DuckDB counts terms and sums pairs of sources within hash shards of (lang, term).

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that occur in
``MIN_DOCS`` of its documents or more; ``V`` is their number. A group (lang, source), and a language, gives each kept
term the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by f = floor((p - q)^2 / (p + q)).

1. Every task counts the terms of its documents in DuckDB, a slice of whole documents at a time, and Spark adds the
   counts up by (lang, source, term), so a frequent term is combined before it is shuffled.
2. (lang, term) is hashed to shards. A shard is sorted, and DuckDB takes it in stretches of whole terms: one SQL
   statement keeps the frequent ones.
3. Spark sums up N and V and attaches them. The shards are dealt out again, and one SQL statement for each stretch gives
   the partial sums: for two sources that share terms by how much f there is off from f without either (a sum for a
   pair of sources, not a row for a term), how many terms of a source have a given count, and each source's best terms.
4. Spark adds the partial sums. Terms that one source lacks are told by the other's counts alone, so they need no row.

All numbers are whole, and wide where they may be large, so the result is exact. Documents without terms still make
their group; nulls in text, lang or source are empty strings; repeated rows are documents of their own. Ties in value
go to the lesser item by its UTF-8 bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, looked_up

MIN_DOCS, BEST, PRIOR, SCALE = 10, 10, 2, 1_000_000_000
#: Bytes of text that DuckDB counts at once, and count rows that it takes at once.
SLICE, ROWS = 1 << 23, 1 << 18
#: Fixed value: what a term is made of.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_OTHER = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

COUNT_SQL = f"""INSERT INTO part SELECT doc, term, count(*) FROM (SELECT doc, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM pieces) GROUP BY ALL"""
SLICE_SQL = """SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs
 FROM (SELECT doc, term, sum(n) AS n FROM part GROUP BY ALL) JOIN owners USING (doc) GROUP BY ALL"""
KEEP_SQL = """SELECT lang, term, source, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INTEGER AS head,
 (sum(n) OVER (PARTITION BY lang, term))::BIGINT AS total FROM rows QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}"""
SHARE = f"(1 + ({SCALE}::HUGEINT * ({{count}} + {PRIOR})) // ({{size}} + {PRIOR} * terms::HUGEINT))::BIGINT"
APART = "({p} - {q}) * ({p} - {q}) // ({p} + {q})"
PARTIAL_SQL = f"""WITH s AS (SELECT lang, term, source, n, {SHARE.format(count="n", size="size")} AS p, {SHARE.format(count="0", size="size")} AS z, {SHARE.format(count="total", size="lang_size")} AS q FROM rows),
o AS (SELECT lang, source, term, {APART.format(p="p", q="q")} AS f FROM s WHERE p > q),
t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {{best}})
SELECT 'both' AS kind, lang, a.source, b.source AS item, 0::BIGINT AS k, sum({APART.format(p="a.p", q="b.p")} - {APART.format(p="a.p", q="b.z")} - {APART.format(p="a.z", q="b.p")} + {APART.format(p="a.z", q="b.z")})::BIGINT AS value
 FROM s a JOIN s b USING (lang, term) WHERE a.source < b.source GROUP BY lang, a.source, b.source
UNION ALL SELECT 'count', lang, source, '', n, count(*) FROM s GROUP BY lang, source, n
UNION ALL SELECT 'term', lang, source, term, 0, f FROM t"""
COUNTED, KEPT = "lang string, source string, term string, n long, docs long", "lang string, term string, source string, n long, head int, total long"
PARTIAL = "kind string, lang string, source string, item string, k long, value long"


def connected() -> object:
    """A DuckDB of this task alone, with one thread and no files."""
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1; SET temp_directory = ''; SET preserve_insertion_order = false")
    return con


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in stretches of about ``size`` characters that end where no term goes on."""
    at = 0
    while at < len(text):
        stop = _OTHER.search(text, at + size)
        end = stop.end() if stop else len(text)
        yield text[at:end]
        at = end


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, bool]]:
    """``doc``, ``text`` of some ``SLICE`` bytes, and whether a document ends with them."""
    sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        if sizes[at] > 2 * SLICE:
            each = list(pieces(batch.column("text")[at].as_py(), SLICE))
            for i, piece in enumerate(each):
                yield pa.table({"doc": pa.array([at], pa.int64()), "text": pc.ascii_lower(pa.array([piece], pa.string()))}), i == len(each) - 1
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + SLICE, side="right")))
        large = np.flatnonzero(sizes[at:stop] > 2 * SLICE)
        stop = at + int(large[0]) if len(large) else stop
        yield pa.table({"doc": np.arange(at, stop), "text": pc.ascii_lower(batch.column("text").slice(at, stop - at))}), True
        at = stop


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = connected()
    con.execute("CREATE TABLE part (doc BIGINT, term VARCHAR, n BIGINT)")
    for batch in batches:
        con.register("owners", pa.table({"doc": np.arange(batch.num_rows), "lang": batch.column("lang"), "source": batch.column("source")}))
        for texts, ended in slices(batch):
            con.register("pieces", texts)
            con.execute(COUNT_SQL)
            if ended:
                yield from _answer(con, SLICE_SQL, COUNTED)
                con.execute("TRUNCATE part")


def _answer(con: object, sql: str, schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(n, kinds[t]) for n, t in (f.strip().split(" ") for f in schema.split(","))])
    yield from con.sql(sql).to_arrow_table().cast(fields).to_batches(max_chunksize=1 << 16)


def shard_sql(sql: str, schema: str) -> object:
    """A function for sorted shards: ``sql`` over ``rows``, stretches of whole (lang, term), one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, held, size = connected(), [], 0

        def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("rows", rows)
            yield from _answer(con, sql, schema)

        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = pc.and_(pc.equal(rows["lang"], rows["lang"][-1]), pc.equal(rows["term"], rows["term"][-1]))
            stop = pc.index(last, True).as_py()
            if stop:
                yield from answer(rows.slice(0, stop))
            held, size = rows.slice(stop).combine_chunks().to_batches(), rows.num_rows - stop
        if size:
            yield from answer(pa.Table.from_batches(held))

    return run


def share(n: int | str, total: str) -> Column:
    """The share p of a count ``n`` among ``total``; needs the column ``terms``. 1 where no term is kept."""
    top = f"CAST({SCALE} AS DECIMAL(12,0)) * CAST({n} + {PRIOR} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN terms > 0 THEN 1 + ({top}) div (CAST({total} AS DECIMAL(20,0)) + {PRIOR} * CAST(terms AS DECIMAL(18,0))) ELSE 1L END")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, best: int = BEST) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far sources of a language are apart, and by which terms."""
    if min_docs < 1 or best < 1:
        raise ValueError("min_docs and best are 1 at least")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(count_terms, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sharded = lambda df: df.repartition("lang", "term").sortWithinPartitions("lang", "term")
    kept = cut(sharded(counts).mapInArrow(shard_sql(KEEP_SQL.format(least=min_docs), KEPT), KEPT))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum("head").cast("long").alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    each = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(each.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "lang_size", "terms")]))
    partial = cut(sharded(looked_up(kept, groups, ["lang", "source"])).mapInArrow(shard_sql(PARTIAL_SQL.format(best=best), PARTIAL), PARTIAL))

    # One row for two different sources of a language, which the result has too.
    own = groups.select("lang", "source", "size", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("other_size"))
    pairs = looked_up(own, other, ["lang"]).filter("source <> item").withColumn("z", share(0, "size")).withColumn("y", share(0, "other_size"))
    neither = pairs.select("lang", "source", "item", (F.col("terms") * apart("z", "y")).alias("value"))
    counted = partial.filter("kind = 'count'").groupBy("lang", "source", "k").agg(F.sum("value").alias("n"))
    one = looked_up(looked_up(counted, own, ["lang", "source"]), other, ["lang"]).filter("source <> item")
    one = one.withColumn("p", share("k", "size")).withColumn("z", share(0, "size")).withColumn("y", share(0, "other_size"))
    alone = one.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (apart("p", "y") - apart("z", "y"))).alias("value"))
    both = partial.filter("kind = 'both'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    swap = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = neither.union(alone).union(swap(alone)).union(both).union(swap(both))
    found = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    named = partial.filter("kind = 'term'").select("lang", "source", "item", "value").withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    place = F.row_number().over(order)
    ranked = found.withColumn("rank", place).unionByName(named.withColumn("rank", place).filter(F.col("rank") <= best))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


_P = f"(1 + ({SCALE}::HUGEINT * ({{count}} + {PRIOR})) // ({{size}} + {PRIOR} * kept))::HUGEINT"
#: DuckDB SQL for ``audit`` over ``documents``.
AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM w GROUP BY ALL HAVING count(*) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS kept, sum(total) AS lang_size FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(x.n, 0) AS n FROM g JOIN k USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, {_P.format(count="c.n", size="s.size")} AS p, {_P.format(count="c.total", size="lang_size")} AS q FROM c JOIN s USING (lang, source) JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {BEST}
"""
