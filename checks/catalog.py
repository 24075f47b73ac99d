"""Registry of the queries and helpers they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import clean_tokens
from topicloom.runtime import spread_small

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# A stop list of words and word pieces that are frequent in the given documents.
STOP = tuple("the and of that to in is on for with this le la de des et que el los der die und den ein zu".split())
SECOND_STOP = tuple("er th ti es ing ment eau der".split())


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# --- documents -----------------------------------------------------------------------------------

SQL_NORMAL = (
    "regexp_replace(replace(replace(replace(replace(replace(replace(replace(lower(coalesce(text, '')), "
    "repeat(chr(160), 4), ' '), chr(13), ' '), chr(10), ' '), chr(9), ' '), 'n''t', ' '), '''m', ' '), '''ll', ' '), "
    "'[^a-z ]', ' ', 'g')"
)
SQL_WORDS = f"[t for t in string_split({SQL_NORMAL}, ' ') if t <> '']"
SQL_TOKENS = f"[t for t in string_split({SQL_NORMAL}, ' ') if length(t) > 1 and not list_contains({sql_list(STOP)}, t)]"
SQL_DOCS = f"docs AS (SELECT doc_id, lang, source, text, {SQL_TOKENS} AS tokens FROM documents)"


def tokens_of(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread_small(table(spark, folder, "documents"))
    return documents.select("doc_id", "lang", "source", "text", clean_tokens("text", STOP).alias("tokens"))


# --- orders as dated, labelled cases -------------------------------------------------------------

SQL_CASES = r"""
cases AS (
  SELECT o_orderkey, CAST(o_custkey % 20 AS INTEGER) AS topic_number,
    CASE o_orderkey % 3 WHEN 0 THEN 'https://example.org/case/' || year(o_orderdate) || '/' || o_orderkey || '.html'
      WHEN 1 THEN 'https://example.org/case-' || year(o_orderdate) || '-x.html'
      ELSE 'https://example.org/case/none.html' END AS case_url
  FROM orders),
dated AS (
  SELECT * FROM (SELECT *, CAST(coalesce(nullif(regexp_extract(case_url, '/(\d{4})/', 1), ''),
      nullif(regexp_extract(case_url, '\b(1[7-9]\d{2}|20[0-2]\d)\b', 1), '')) AS INTEGER) AS year FROM cases)
  WHERE year IS NOT NULL),
counts AS (SELECT year, topic_number, count(*) AS n FROM dated GROUP BY year, topic_number)
"""


def cases_of(spark: SparkSession, folder: str, topics: int = 20) -> DataFrame:
    orders = spread_small(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    year, key = F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    url = (
        F.when(key % 3 == 0, F.concat(F.lit("https://example.org/case/"), year, F.lit("/"), key.cast("string"), F.lit(".html")))
        .when(key % 3 == 1, F.concat(F.lit("https://example.org/case-"), year, F.lit("-x.html")))
        .otherwise(F.lit("https://example.org/case/none.html"))
    )
    return orders.select("o_orderkey", (F.col("o_custkey") % topics).cast("int").alias("topic_number"), url.alias("case_url"))


SQL_STUDY = """
study AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey % 30 AS INTEGER) AS topic_number FROM orders),
merged AS (
  SELECT *, CAST(CASE topic_number WHEN 20 THEN 24 WHEN 25 THEN 1 WHEN 2 THEN 12 WHEN 27 THEN 26 WHEN 18 THEN 29 WHEN 5 THEN 29
      WHEN 8 THEN 7 WHEN 22 THEN 7 WHEN 15 THEN 16 WHEN 9 THEN 14 WHEN 19 THEN 3 ELSE topic_number END AS INTEGER) AS condensedtopics
  FROM study),
details AS (
  SELECT CAST(p_size AS INTEGER) AS condensedtopics, min(p_name) AS topicname, min(p_brand) AS title,
    'https://example.org/' || p_size AS "exampleURL", min(p_type) AS leadpp, max(p_name) AS topicwords
  FROM part WHERE p_size <= 26 GROUP BY p_size)
"""


def study_of(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 30).cast("int").alias("topic_number"))


def details_of(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").where("p_size <= 26")
    return part.groupBy(F.col("p_size").cast("int").alias("condensedtopics")).agg(
        F.min("p_name").alias("topicname"),
        F.min("p_brand").alias("title"),
        F.concat(F.lit("https://example.org/"), F.first("p_size").cast("string")).alias("exampleURL"),
        F.min("p_type").alias("leadpp"),
        F.max("p_name").alias("topicwords"),
    )
