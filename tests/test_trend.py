from pyspark.sql import functions as F

from topicloom.operators import chart, trend


def cases(spark, rows):
    return spark.createDataFrame(rows, "year int, topic_number int")


def test_complete_grid_fills_gaps(spark):
    got = {(r[0], r[1]): (r[2], r[3]) for r in trend.trend_table(cases(spark, [(1, 0), (3, 2), (3, 2)])).collect()}
    assert len(got) == 9 and got[(2, 1)] == (0, "Topic 1") and got[(3, 2)] == (2, "Topic 2")
    assert sum(n for n, _ in got.values()) == 3


def test_observed_grid_does_not(spark):
    counts = trend.year_topic_counts(cases(spark, [(1, 0), (3, 2)]))
    filled = trend.fill_grid(trend.observed_grid(counts), counts, ["year", "topic_number"], kind="double")
    assert {tuple(r) for r in filled.collect()} == {(1, 0, 1.0), (1, 2, 0.0), (3, 0, 0.0), (3, 2, 1.0)}
    pivoted = trend.melt(trend.pivot_fill(counts, trend.observed_topics(counts)))
    assert {(r["year"], r["topic_number"], r["count"]) for r in pivoted.collect()} == {tuple(r) for r in filled.collect()}


def test_empty_input(spark):
    assert trend.trend_table(cases(spark, [])).count() == 0


def test_cases_are_read_and_shuffled_once(spark, tmp_path):
    cases(spark, [(1, 0), (3, 2)]).write.parquet(str(tmp_path / "cases"))
    table = trend.trend_table(spark.read.parquet(str(tmp_path / "cases")))
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_condensed_trend(spark):
    rows = cases(spark, [(1, 20), (1, 24), (2, 2), (2, 5), (2, 29), (1, 0)])
    details = spark.createDataFrame([(24, "a", "", "", "", ""), (29, "b", "", "", "", ""), (7, "c", "", "", "", "")], "condensedtopics int, topicname string, title string, exampleURL string, leadpp string, topicwords string")
    got = [(r["year"], r["condensedtopics"], r["count"], r["topicname"]) for r in trend.condensed_trend(rows, details).collect()]
    assert got == [(1, 24, 2.0, "a"), (1, 29, 0.0, "b"), (2, 24, 0.0, "a"), (2, 29, 2.0, "b")]
    assert {tuple(r) for r in trend.year_sums(trend.condensed_trend(rows, details)).collect()} == {(1, 2.0), (2, 2.0)}


def test_stack_is_consistent(spark):
    rows = [(str(2000 + d), k, float(d + k)) for d in range(3) for k in range(3)]
    series = spark.createDataFrame(rows, "date string, key int, value double")
    stacked = chart.stack_layers(series)
    last = {r["date"]: r["y0"] + r["y"] for r in stacked.where("key = 2").collect()}
    assert last == {r["date"]: r["s"] for r in series.groupBy("date").agg(F.sum("value").alias("s")).collect()}
    assert tuple(chart.chart_extents(stacked).first()) == ("2000", "2002", 9.0, 9.0)
    assert {(r["key"], r["date"]) for r in chart.first_per_key(series).collect()} == {(k, "2000") for k in range(3)}


def test_cumulative_curve(spark):
    per_year = spark.createDataFrame([(2, 30), (1, 10)], "year int, count int")
    assert [(r[0], round(r[2], 6)) for r in chart.cumulative_curve(per_year).orderBy("year").collect()] == [(1, 0.1), (2, 0.4)]


def test_selections(spark):
    rows = cases(spark, [(1, 0), (2, 1), (3, 1)])
    assert trend.between_years(rows, None).count() == 3 and trend.between_years(rows, (2, 3)).count() == 2
    assert trend.select_layer(rows, None, "topic_number").count() == 3 and trend.select_layer(rows, 1, "topic_number").count() == 2


def test_summary_lists_empty_topics(spark):
    words = spark.createDataFrame([(0, "a, b"), (2, "x" * 120)], "topic_number int, topic_words string")
    rows = [tuple(r) for r in trend.topic_summary(cases(spark, [(1, 0), (1, 0)]), words, 3).collect()]
    assert rows == [(0, 2, "a, b"), (1, 0, None), (2, 0, "x" * 100 + "...")]
    top = [tuple(r) for r in trend.top_topics(cases(spark, [(1, 1), (1, 0), (1, 2), (1, 2)]), words, 2).orderBy(F.desc("count")).collect()]
    assert top == [(2, 2, "x" * 80 + "..."), (0, 1, "a, b...")]
