"""Document and candidate sources whose items come in several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.numbering import numbered

DOCUMENT = "struct<text:string,doc_id:bigint,external_id:string,metadata:map<string,string>>"
CANDIDATE = "struct<text:string,doc_id:string,external_id:string,score:double,metadata:map<string,string>>"


def from_texts(texts: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``texts`` with ``doc_id`` from 0 in ``order`` (the text's, if none is given)."""
    return numbered(texts, order or [text], "doc_id")


def from_collection(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", external_id: str | None = None, metadata: str | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``external_id``, ``metadata`` of a collection; without such columns, null and an empty map."""
    none = F.create_map().cast("map<string,string>")
    return rows.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(external_id).cast("string") if external_id else F.lit(None).cast("string")).alias("external_id"),
        (F.coalesce(F.col(metadata), none) if metadata else none).alias("metadata"),
    )


def external_ids(rows: DataFrame) -> DataFrame:
    """Candidates with ``external_id`` out of their metadata again, which keeps the rest."""
    rest = F.map_filter("metadata", lambda k, _: k != "external_id")
    return rows.withColumn("external_id", F.try_element_at("metadata", F.lit("external_id"))).withColumn("metadata", rest)


def _checked(item: Column, parsed: Column) -> Column:
    wrong = F.concat(F.lit("documents need a string or an object with text, not: "), F.substring(item, 1, 200))
    return F.when(parsed["text"].isNotNull(), parsed["text"]).otherwise(F.raise_error(wrong).cast("string"))


def documents(items: DataFrame, item: str = "item", order: list[str] | None = None) -> DataFrame:
    """JSON items, each a string or ``{text, doc_id?, external_id?, metadata?}``, as rows. Ids default to the place in ``order``.

    Anything else raises an error that shows the item.
    """
    c = F.col(item)
    plain = c.startswith('"')
    parsed = F.from_json(F.when(plain, F.concat(F.lit('{"text":'), c, F.lit("}"))).otherwise(c), DOCUMENT)
    rows = numbered(items, order or [item], "__n").withColumn("__p", parsed)
    return rows.select(_checked(c, F.col("__p")).alias("text"), F.coalesce("__p.doc_id", "__n").alias("doc_id"), F.col("__p.external_id").alias("external_id"), F.coalesce("__p.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def checked(items: DataFrame, item: str = "item", order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``documents``, but bad items stop nothing: the good rows, and ``place``, ``field``, ``reason``, ``item`` of the others.

    ``place`` counts all items in ``order``. An item is bad if it is not JSON, neither a string nor an object, has no ``text`` that is a
    string, or has a ``doc_id`` that is no whole number, an ``external_id`` that is no string or ``metadata`` that is no
    object; null counts as absent in the last three. The first such field is named. A null item is no JSON.
    """
    rows = numbered(items.select(item, *[c for c in order or [] if c != item]), order or [item], "place")
    v = F.try_parse_json(item)
    part = lambda name: F.try_variant_get("__v", f"$.{name}", "variant")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    told = rows.withColumn("__v", v).withColumn("__k", kind(F.col("__v"))).withColumns({f"__{n}": kind(part(n)) for n in ("text", "doc_id", "external_id", "metadata")})
    plain, whole = F.col("__k") == "STRING", F.col("__k").startswith("OBJECT")
    named = F.when(F.col("__v").isNull(), F.lit("item")).when(plain, F.lit(None)).when(~whole, F.lit("item"))
    named = named.when(F.col("__text") != "STRING", F.lit("text")).when(~F.col("__doc_id").isin("BIGINT", "VOID"), F.lit("doc_id"))
    named = named.when(~F.col("__external_id").isin("STRING", "VOID"), F.lit("external_id")).when(~F.col("__metadata").startswith("OBJECT") & (F.col("__metadata") != "VOID"), F.lit("metadata"))
    found = F.when(F.col("__v").isNull(), "malformed").when(F.col("field") == "item", F.concat(F.lit("found "), "__k")).otherwise(F.concat(F.lit("found "), F.when(F.col("field") == "text", F.col("__text")).when(F.col("field") == "doc_id", F.col("__doc_id")).when(F.col("field") == "external_id", F.col("__external_id")).otherwise(F.col("__metadata"))))
    told = told.withColumn("field", named)
    none = F.create_map().cast("map<string,string>")
    text = F.when(plain, F.try_variant_get("__v", "$", "string")).otherwise(F.try_variant_get("__v", "$.text", "string"))
    good = told.filter("field IS NULL").select(
        text.alias("text"), F.coalesce(F.try_variant_get("__v", "$.doc_id", "bigint"), "place").alias("doc_id"), F.try_variant_get("__v", "$.external_id", "string").alias("external_id"),
        F.coalesce(F.try_variant_get("__v", "$.metadata", "map<string,string>"), none).alias("metadata"))
    return good, told.filter("field IS NOT NULL").select("place", "field", found.alias("reason"), F.col(item).alias("item"))


def candidates(items: DataFrame, item: str = "item") -> DataFrame:
    """Rerank candidates: ids as strings, ``score`` 0 by default, ``external_id`` kept in the metadata."""
    c = F.col(item)
    parsed = F.from_json(F.when(c.startswith('"'), F.concat(F.lit('{"text":'), c, F.lit("}"))).otherwise(c), CANDIDATE)
    p = items.withColumn("__p", parsed)
    own = F.when(F.col("__p.external_id").isNotNull(), F.create_map(F.lit("external_id"), F.col("__p.external_id"))).otherwise(F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter(F.coalesce("__p.metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != "external_id"), own)
    return p.select(_checked(c, F.col("__p")).alias("text"), F.col("__p.doc_id").alias("doc_id"), F.coalesce("__p.score", F.lit(0.0)).alias("score"), metadata.alias("metadata"))


def corpus_lines(spark: SparkSession, path: str, records: int | None = None) -> DataFrame:
    """``id``, ``text`` of JSON lines that have text, content or body; blank lines are skipped. ``records``: so many at the most."""
    rows = spark.read.schema("id string, text string, content string, body string").json(path)
    rows = rows if records is None else rows.limit(records)
    return rows.select("id", T.first_text("text", "content", "body").alias("text"))


def sentence_lines(spark: SparkSession, path: str) -> DataFrame:
    """``sentence`` of every line that is not blank, trimmed."""
    return spark.read.text(path).select(T.strip("value").alias("sentence")).filter("sentence <> ''")


def golden(spark: SparkSession, answers: str, texts: str) -> DataFrame:
    """JSON-lines answers (``doc_id``, ``clause_answers``) joined with the text files named ``doc_id.txt``; others are left out."""
    gold = spark.read.schema("doc_id string, clause_answers map<string,array<string>>").json(answers)
    files = spark.read.text(texts, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))
    return gold.join(files, "doc_id")


def config_labels(spark: SparkSession, path: str) -> DataFrame:
    """``class``, ``label`` of a model config's ``id2label``; an error unless the classes run from 0 without gaps."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<id2label:map<string,string>>")["id2label"].alias("m"))
    each = whole.select(F.explode("m").alias("k", "label")).select(F.col("k").cast("int").alias("class"), "label").orderBy("class")
    n, low, high, distinct = each.agg(F.count("*"), F.min("class"), F.max("class"), F.count_distinct("class")).first()
    if n == 0 or (low, high, distinct) != (0, n - 1, n):
        raise ValueError("id2label has to number its labels from 0 without gaps")
    return each


def write_vectors(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    rows.write.mode("overwrite").json(path)
