"""Joins, aggregates, windows, dates and trend tables over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import SQL_CASES, SQL_STUDY, cases_of, details_of, query, study_of, table
from topicloom.functions.urls import year_from_case_id, year_from_url
from topicloom.operators import chart, trend

WITH = f"WITH {SQL_CASES}"
STUDY = f"WITH {SQL_STUDY}"


def dated_of(spark, folder):
    return trend.with_year(cases_of(spark, folder))


@query("year_from_url", f"{WITH} SELECT o_orderkey, year FROM dated UNION ALL SELECT o_orderkey, NULL FROM cases WHERE case_url LIKE '%none%'")
def _(spark, folder):
    return cases_of(spark, folder).select("o_orderkey", year_from_url(F.col("case_url")).alias("year"))


@query("year_topic_counts", f'{WITH} SELECT year, topic_number, n AS "count" FROM counts')
def _(spark, folder):
    return trend.year_topic_counts(dated_of(spark, folder))


@query("yearly_totals", f"{WITH} SELECT year, count(*) AS total_cases FROM dated GROUP BY year")
def _(spark, folder):
    return trend.yearly_totals(dated_of(spark, folder))


GRID = """bounds AS (SELECT min(year) AS a, max(year) AS b, max(topic_number) AS t FROM counts),
grid AS (SELECT CAST(y AS INTEGER) AS year, CAST(k AS INTEGER) AS topic_number FROM (SELECT unnest(range(a, b + 1)) AS y, t FROM bounds), (SELECT unnest(range(0, t + 1)) AS k FROM bounds))"""


@query("year_topic_grid", f"{WITH}, {GRID} SELECT year, topic_number FROM grid")
def _(spark, folder):
    return trend.year_topic_grid(trend.year_topic_counts(dated_of(spark, folder)))


@query("grid_left_join", f'{WITH}, {GRID} SELECT year, topic_number, CAST(coalesce(n, 0) AS INTEGER) AS "count" FROM grid LEFT JOIN counts USING (year, topic_number)')
def _(spark, folder):
    counts = trend.year_topic_counts(dated_of(spark, folder))
    return trend.fill_grid(trend.year_topic_grid(counts), counts, ["year", "topic_number"])


@query(
    "topic_trend",
    f"""{WITH}, {GRID} SELECT year, topic_number, CAST(coalesce(n, 0) AS INTEGER) AS "count", 'Topic ' || topic_number AS topic_name
    FROM grid LEFT JOIN counts USING (year, topic_number)""",
)
def _(spark, folder):
    return trend.trend_table(dated_of(spark, folder))


@query("topic_value_counts", f'{WITH} SELECT topic_number, count(*) AS "count" FROM dated GROUP BY topic_number ORDER BY 2 DESC, 1')
def _(spark, folder):
    return trend.value_counts(dated_of(spark, folder), "topic_number")


@query("topic_index_counts", f'{WITH} SELECT topic_number, count(*) AS "count" FROM dated GROUP BY topic_number ORDER BY 1')
def _(spark, folder):
    return trend.value_counts(dated_of(spark, folder), "topic_number", by_index=True)


@query(
    "count_all_columns",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(o_orderkey) AS o_orderkey, count(nullif(o_orderpriority, '1-URGENT')) AS priority,
    count(CASE WHEN o_totalprice > 1000 THEN o_totalprice END) AS price FROM orders GROUP BY 1""",
)
def _(spark, folder):
    return trend.count_every_column(
        table(spark, folder, "orders").select(
            F.year("o_orderdate").alias("year"),
            "o_orderkey",
            F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"),
            F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"),
        )
    )


@query("topic_condense", f"{STUDY} SELECT topic_number, condensedtopics, count(*) AS n FROM merged GROUP BY 1, 2")
def _(spark, folder):
    return trend.with_condensed(study_of(spark, folder)).groupBy("topic_number", "condensedtopics").agg(F.count(F.lit(1)).alias("n"))


@query("topic_exclude", f"{STUDY} SELECT year, topic_number, count(*) AS n FROM study WHERE topic_number <> 2 GROUP BY 1, 2")
def _(spark, folder):
    return trend.count_by(trend.exclude_topic(study_of(spark, folder), 2), "year", "topic_number", name="n")


@query("condensed_counts", f'{STUDY} SELECT year, condensedtopics, count(1) AS "count" FROM merged GROUP BY 1, 2')
def _(spark, folder):
    return trend.condensed_counts(trend.with_condensed(study_of(spark, folder)))


@query("details_join", f"{STUDY} SELECT year, condensedtopics, topicname, title, count(*) AS n FROM merged JOIN details USING (condensedtopics) GROUP BY ALL")
def _(spark, folder):
    joined = trend.join_details(trend.with_condensed(study_of(spark, folder)), details_of(spark, folder))
    return trend.count_by(joined, "year", "condensedtopics", "topicname", "title", name="n")


# Orders in even years with an odd topic are left out, so that observed pairs have gaps to fill.
GAPS = """gaps AS (SELECT year, topic_number, count(*) AS n FROM study WHERE NOT (year % 2 = 0 AND topic_number % 2 = 1) GROUP BY 1, 2)"""
FILLED = """filled AS (SELECT y.year, k.topic_number, CAST(coalesce(n, 0) AS DOUBLE) AS "count" FROM (SELECT DISTINCT year FROM gaps) y
  CROSS JOIN (SELECT DISTINCT topic_number FROM gaps) k LEFT JOIN gaps ON gaps.year = y.year AND gaps.topic_number = k.topic_number)"""


def gaps_of(spark, folder):
    kept = study_of(spark, folder).where("NOT (year % 2 = 0 AND topic_number % 2 = 1)")
    return trend.year_topic_counts(kept)


@query("pivot_fill_unpivot", f"{STUDY}, {GAPS}, {FILLED} SELECT * FROM filled")
def _(spark, folder):
    counts = gaps_of(spark, folder)
    return trend.melt(trend.pivot_fill(counts, trend.observed_topics(counts)), value="count").select("year", "topic_number", "count")


@query("observed_grid_fill", f"{STUDY}, {GAPS}, {FILLED} SELECT * FROM filled")
def _(spark, folder):
    counts = gaps_of(spark, folder)
    return trend.fill_grid(trend.observed_grid(counts), counts, ["year", "topic_number"], kind="double")


@query("year_sum", f'{STUDY}, {GAPS}, {FILLED} SELECT year, sum("count") AS "count" FROM filled GROUP BY year')
def _(spark, folder):
    counts = gaps_of(spark, folder)
    return trend.year_sums(trend.fill_grid(trend.observed_grid(counts), counts, ["year", "topic_number"], kind="double"))


CONDENSED = """cc AS (SELECT year, condensedtopics, count(*) AS n FROM merged JOIN details USING (condensedtopics) WHERE topic_number <> 2 GROUP BY 1, 2),
cfilled AS (SELECT y.year, k.condensedtopics, CAST(coalesce(n, 0) AS DOUBLE) AS "count" FROM (SELECT DISTINCT year FROM cc) y
  CROSS JOIN (SELECT DISTINCT condensedtopics FROM cc) k LEFT JOIN cc ON cc.year = y.year AND cc.condensedtopics = k.condensedtopics),
chart AS (SELECT year, condensedtopics, "count", topicname, title, "exampleURL", leadpp, topicwords FROM cfilled JOIN details USING (condensedtopics))"""


@query("condensed_trend", f"{STUDY}, {CONDENSED} SELECT * FROM chart ORDER BY year, condensedtopics")
def _(spark, folder):
    return trend.condensed_trend(study_of(spark, folder), details_of(spark, folder))


@query("viewer_layout", f"""{STUDY}, {CONDENSED} SELECT CAST(year AS VARCHAR) AS date, "count" AS value, topicname AS key, title, leadpp, topicwords, "exampleURL" FROM chart""")
def _(spark, folder):
    return trend.viewer_layout(trend.condensed_trend(study_of(spark, folder), details_of(spark, folder)))


@query("sorted_series", f'{STUDY} SELECT year, topic_number, count(*) AS "count" FROM study GROUP BY 1, 2 ORDER BY 1, 2')
def _(spark, folder):
    return trend.sorted_series(trend.year_topic_counts(study_of(spark, folder)), "year", "topic_number")


WORDS = """words AS (SELECT CAST(p_size % 20 AS INTEGER) AS topic_number, string_agg(p_name, ', ' ORDER BY p_partkey) AS topic_words FROM part WHERE p_size % 20 < 15 GROUP BY 1)"""


def words_of(spark, folder):
    part = table(spark, folder, "part").where("p_size % 20 < 15")
    named = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda e: e["p_name"])
    return part.groupBy((F.col("p_size") % 20).cast("int").alias("topic_number")).agg(F.array_join(named, ", ").alias("topic_words"))


@query("topic_words_lookup", f"{WITH}, {WORDS} SELECT o_orderkey, topic_number, substring(topic_words, 1, 40) AS topic_words FROM cases LEFT JOIN words USING (topic_number)")
def _(spark, folder):
    return trend.lookup_words(cases_of(spark, folder), words_of(spark, folder)).select(
        "o_orderkey", "topic_number", F.substring("topic_words", 1, 40).alias("topic_words")
    )


@query(
    "top_topics",
    f"""{WITH}, {WORDS} SELECT topic_number, "count", substring(topic_words, 1, 80) || '...' AS keywords FROM
    (SELECT topic_number, count(*) AS "count" FROM cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) LEFT JOIN words USING (topic_number)""",
)
def _(spark, folder):
    return trend.top_topics(cases_of(spark, folder), words_of(spark, folder))


@query("cumulative_curve", f'{WITH}, y AS (SELECT year, count(*) AS "count" FROM dated GROUP BY year) SELECT year, "count", round(sum("count" * 0.01::DOUBLE) OVER (ORDER BY year), 6) AS cumulative FROM y')
def _(spark, folder):
    curve = chart.cumulative_curve(trend.count_by(dated_of(spark, folder), "year"))
    return curve.withColumn("cumulative", F.round("cumulative", 6))


STACK = f"""{STUDY}, {CONDENSED}, series AS (SELECT CAST(year AS VARCHAR) AS date, condensedtopics AS key, "count" AS value FROM chart),
stacked AS (SELECT date, key, value AS y, coalesce(sum(value) OVER (PARTITION BY date ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM series)"""


def series_of(spark, folder):
    shown = trend.condensed_trend(study_of(spark, folder), details_of(spark, folder))
    return shown.select(F.col("year").cast("string").alias("date"), F.col("condensedtopics").alias("key"), F.col("count").alias("value"))


@query("stack_layers", f"{STACK} SELECT * FROM stacked")
def _(spark, folder):
    return chart.stack_layers(series_of(spark, folder))


@query("chart_extents", f"{STACK} SELECT (SELECT min(date) FROM series) AS first_date, (SELECT max(date) FROM series) AS last_date, (SELECT max(v) FROM (SELECT sum(value) AS v FROM series GROUP BY date)) AS max_value, (SELECT max(y0 + y) FROM stacked) AS max_stack")
def _(spark, folder):
    return chart.chart_extents(chart.stack_layers(series_of(spark, folder)))


@query(
    "first_per_key",
    """SELECT date, key, totalprice FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 30 AS key, o_totalprice AS totalprice,
    row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY CAST(o_orderdate AS DATE), o_totalprice) AS rn FROM orders) WHERE rn = 1""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 30).alias("key"), F.col("o_totalprice").alias("totalprice")
    )
    return chart.first_per_key(rows)


@query("year_from_case_id", "SELECT o_orderkey, CAST(string_split(year(o_orderdate) || '-' || o_orderkey, '-')[1] AS INTEGER) AS year FROM orders")
def _(spark, folder):
    case_id = F.concat_ws("-", F.year("o_orderdate"), "o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", year_from_case_id(case_id).alias("year"))


@query("parse_year_date", "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS date, CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS value FROM orders")
def _(spark, folder):
    year, price = F.year("o_orderdate").cast("string"), F.col("o_totalprice").cast("string")
    return chart.parse_series(table(spark, folder, "orders").select("o_orderkey", year.alias("date"), price.alias("value")))


@query("year_window", f"{WITH} SELECT year, topic_number, count(*) AS n FROM dated WHERE year BETWEEN 1997 AND 1999 GROUP BY 1, 2")
def _(spark, folder):
    return trend.count_by(trend.between_years(dated_of(spark, folder), (1997, 1999)), "year", "topic_number", name="n")


@query("layer_select", f'{STACK} SELECT date, key, value FROM series WHERE key = 7')
def _(spark, folder):
    return trend.select_layer(series_of(spark, folder), 7)


@query("year_index_urls", "SELECT CAST(y AS INTEGER) AS year, 'https://example.org/years/' || y AS index_url FROM (SELECT unnest(range(a, b + 1)) AS y FROM (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders))")
def _(spark, folder):
    from topicloom.sources.pages import index_urls_between

    bounds = table(spark, folder, "orders").agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))
    return index_urls_between(bounds, "https://example.org/years/")


@query("topic_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS topic_number, round(CAST(list_max(embedding) AS DOUBLE), 6) AS topic_strength FROM embeddings")
def _(spark, folder):
    from topicloom.operators.topics import assign_topics

    labelled = assign_topics(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding")
    return labelled.withColumn("topic_strength", F.round("topic_strength", 6))


@query(
    "topic_summary",
    f"""WITH {WORDS}, best AS (SELECT CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS topic_number FROM embeddings)
    SELECT CAST(k AS INTEGER) AS topic_number, (SELECT count(*) FROM best WHERE best.topic_number = k) AS "count",
    CASE WHEN length(topic_words) > 100 THEN substring(topic_words, 1, 100) || '...' ELSE topic_words END AS keywords
    FROM (SELECT unnest(range(0, 70)) AS k) LEFT JOIN words ON words.topic_number = k""",
)
def _(spark, folder):
    from topicloom.operators.topics import assign_topics

    labelled = assign_topics(table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding")
    return trend.topic_summary(labelled, words_of(spark, folder), 70)
