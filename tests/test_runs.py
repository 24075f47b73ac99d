import pytest
from pyspark.sql import functions as F

from topicloom.operators import corpus
from topicloom.operators.nmf import NmfParams
from topicloom.operators.weights import WeightParams
from topicloom.plans.collect import collect_links, extract_text, extract_text_in_batches
from topicloom.plans.full import RunParams, run_all
from topicloom.plans.preprocess import CleanParams, check_cleaned, clean_documents
from topicloom.sources import files
from topicloom.sources.pages import scan_pages, year_index_urls
from topicloom.sources.stages import MissingStage, StageStore, pending_batches, assign_batches, write_in_batches
from topicloom.streaming import clean_stream

TOPICS = [["tax", "income", "revenue", "levy", "duty"], ["ship", "sea", "harbor", "cargo", "vessel"]]


@pytest.fixture(scope="module")
def crawl(spark):
    """Index pages per year and the case pages they link to."""
    index, cases = [], []
    for year in (1990, 1992):
        hrefs = [f"https://h/c/{year}/{n}-{year}.html" for n in range(6)]
        index.append((year, f"https://h/years/{year}", "".join(f'<a href="{h}">case</a>' for h in hrefs) + '<a href="https://h/c/years/1991">next</a>'))
        for n, href in enumerate(hrefs):
            words = TOPICS[n % 2]
            body = " ".join(words[(i + n) % 5] for i in range(60))
            cases.append((year * 100 + n, href, f'<div class="caselawcontent searchable-content"><p>{body}</p></div>'))
    return spark.createDataFrame(index + cases, "page_id bigint, url string, html string")


def test_whole_run_and_resume(spark, crawl, tmp_path):
    store = StageStore(spark, str(tmp_path))
    params = RunParams(marker="/c/", exclude="/years/", clean=CleanParams(100, 10), weighting=WeightParams(0.95, 2, 100), nmf=NmfParams(2, 42, 20), batch_size=5)
    results = run_all(store, crawl, params)
    assert results["case_urls"].count() == 12
    trend = {(r["year"], r["topic_number"]): r["count"] for r in results["visualization_data"].collect()}
    assert len(trend) == 6 and trend[(1991, 0)] == 0 and trend[(1990, 0)] == trend[(1992, 1)] == 3
    assert {tuple(r) for r in results["yearly_totals"].collect()} == {(1990, 6), (1992, 6)}
    assert tuple(results["summary"].first()) == (12, 2)
    stats = {r["measure"]: tuple(r)[1:] for r in results["text_stats"].collect()}
    lengths = sorted(len(r.case_text) for r in results["full_cases"].collect())
    assert stats["text_length"] == (12, 12, 0, pytest.approx(sum(lengths) / 12), lengths[5], lengths[0], lengths[-1])
    assert stats["token_count"] == (12, 12, 0, 60.0, 60, 60, 60)
    first = results["first_texts"].collect()
    assert len(first) == 3 and all(len(r.text) == 203 and len(r.tokens) == 20 for r in first)
    summary = [(r.topic_number, r["count"], r.keywords) for r in results["topic_summary"].collect()]
    assert [s[:2] for s in summary] == [(0, 6), (1, 6)] and all(w in summary[0][2] + summary[1][2] for w in ("tax", "ship"))
    assert [(r.topic_number, r["count"]) for r in results["top_topics"].collect()] == [(0, 6), (1, 6)]
    again = run_all(store, None, params)
    assert again["topic_modeled"].count() == 12
    assert spark.read.text(f"{tmp_path}/topic_words_json").first()[0].startswith('{"0":"')
    assert files.read_csv(spark, f"{tmp_path}/yearly_totals_csv", "year int, total_cases bigint").count() == 2


def test_missing_and_unfinished_stages(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    with pytest.raises(MissingStage, match="run collect_links first"):
        store.read("case_urls")
    (tmp_path / "case_urls").mkdir()
    with pytest.raises(MissingStage):
        store.read("case_urls")
    with pytest.raises(ValueError, match="pages are needed"):
        run_all(store, None, RunParams())


def test_batches_restart_where_they_stopped(spark, tmp_path):
    path, rows = str(tmp_path / "batches"), spark.range(25).select(F.col("id").alias("key"))
    calls = []

    def slow(part):
        calls.append(sorted(r.key for r in part.collect()))
        if len(calls) == 2:
            raise RuntimeError("lost")
        return part.withColumn("made", F.lit(True))

    with pytest.raises(RuntimeError):
        write_in_batches(rows, path, "key", size=10, max_jobs=3, transform=slow)
    assert {r[0] for r in pending_batches(spark, assign_batches(rows, "key", 10), path).select("batch").distinct().collect()} == {"10_20", "20_25"}
    done = write_in_batches(rows, path, "key", size=10, max_jobs=3, transform=slow)
    assert calls[2][0] == 10 and sorted(r.key for r in done.collect()) == list(range(25))


def test_text_of_cases(spark, crawl, tmp_path):
    cases = collect_links(crawl, "/c/", "/years/").union(spark.createDataFrame([("https://h/c/lost", "1")], "case_url string, docket string"))
    whole = {r.case_url: r.case_text for r in extract_text(cases, crawl).collect()}
    assert whole["https://h/c/lost"] == "" and len(whole) == 13
    copies = crawl.union(crawl.select(F.col("page_id") + 1_000_000, "url", F.lit("<p>later copy</p>")))
    assert {r.case_url: r.case_text for r in extract_text(cases, copies).collect()} == whole
    batched = extract_text_in_batches(cases, crawl, str(tmp_path / "texts"), size=5)
    assert {r.case_url: r.case_text for r in batched.collect()} == whole


def test_thresholds_and_guards(spark):
    ten, nine = "alpha beta " * 5, "alpha beta " * 4 + "gamma "
    rows = [("a", ten.ljust(200, ".")), ("b", ten.ljust(199, ".")), ("c", nine.ljust(200, ".")), ("d", "")]
    docs = spark.createDataFrame(rows, "case_url string, case_text string")
    cleaned = clean_documents(docs)
    assert [(r.case_url, r.text_length, r.token_count) for r in cleaned.collect()] == [("a", 200, 10)]
    assert cleaned.first().processed_text_str == " ".join(["alpha beta"] * 5)
    assert tuple(corpus.removed_count(docs, F.length("case_text"), 200).first()) == (2, 2)
    with pytest.raises(ValueError, match="short texts"):
        check_cleaned(docs.where("case_url = 'd'"), clean_documents(docs.where("case_url = 'd'")))
    with pytest.raises(ValueError, match="stop words"):
        check_cleaned(docs.where("case_url = 'c'"), clean_documents(docs.where("case_url = 'c'")))


def test_the_report_counts_what_each_filter_removes(spark):
    from topicloom.plans.report import stats_table, watched_cleaning

    ten, nine = "alpha beta " * 5, "alpha beta " * 4 + "gamma "
    rows = [("a", ten.ljust(200, ".")), ("b", ten.ljust(199, ".")), ("c", nine.ljust(200, ".")), ("d", ""), ("e", None)]
    docs = spark.createDataFrame(rows, "case_url string, case_text string")
    cleaned, seen = watched_cleaning(docs)
    assert [r.case_url for r in cleaned.collect()] == [r.case_url for r in clean_documents(docs).collect()] == ["a"]
    stats = [tuple(r) for r in stats_table(docs, seen).collect()]
    assert stats == [("text_length", 5, 2, 3, 149.75, 199, 0, 200), ("token_count", 2, 1, 1, 9.5, 9, 9, 10)]


def test_statistics(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "v long")
    assert tuple(corpus.length_stats(rows, F.col("v")).first()) == (3.5, 2.0, 1, 9)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'Café "x", y'), (2, "über\nzwei"), (3, "ñ")], "id int, text string")
    for encoding in ("UTF-8", files.LATIN1):
        files.write_csv(rows, f"{tmp_path}/{encoding}", encoding)
        assert sorted(files.read_csv(spark, f"{tmp_path}/{encoding}", rows.schema, encoding).collect()) == sorted(rows.collect())
    files.write_json(rows, f"{tmp_path}/json")
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/json").count() == 3
    (tmp_path / "words.txt").write_bytes("Été \n\nNames\n".encode("iso-8859-1"))
    assert {r[0] for r in files.read_word_list(spark, f"{tmp_path}/words.txt", files.LATIN1).collect()} == {"été", "names"}


def test_page_sources(spark, crawl, tmp_path):
    assert [r[1] for r in year_index_urls(spark, "https://h/years/", 1990, 1992).collect()] == [f"https://h/years/{y}" for y in (1990, 1991, 1992)]
    assert year_index_urls(spark, "").count() == 259
    crawl.write.parquet(f"{tmp_path}/pages")
    assert scan_pages(spark, f"{tmp_path}/pages").count() == crawl.count()


def test_cleaning_runs_on_a_stream(spark, tmp_path):
    cases = spark.createDataFrame([("https://h/1990/1", "alpha beta " * 30), ("https://h/1990/2", "short"), ("https://h/x", "alpha beta " * 30)], "case_url string, case_text string")
    cases.write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(cases.schema).parquet(f"{tmp_path}/in")
    query = clean_stream(arriving).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.case_url, r.year, r.token_count) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("https://h/1990/1", 1990, 60)]


def test_a_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from topicloom.runtime import is_local, scratch_root

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(session)
    assert is_local("local[8]") and not is_local("local-cluster[3,2,1024]")
