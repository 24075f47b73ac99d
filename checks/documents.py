"""Text, tokens, corpus checks and term weights over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.catalog import SECOND_STOP, SQL_DOCS, SQL_NORMAL, SQL_TOKENS, SQL_WORDS, STOP, query, sql_list, table, tokens_of
from topicloom.functions import text
from topicloom.functions.wordlists import english_words
from topicloom.operators import corpus, tokens, weights
from topicloom.plans.preprocess import CleanParams, clean_documents
from topicloom.plans.report import stats_table, watched_cleaning
from topicloom.runtime import materialise, scratch_root, spread_small
from topicloom.sources import files
from topicloom.sources.stages import StageStore, assign_batches

DOCS = f"WITH {SQL_DOCS}"


# The English stop words of Spark ML.
ENGLISH = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's why's would
""".split())


def documents(spark, folder):
    return table(spark, folder, "documents")


@query("text_normalize", f"SELECT doc_id, {SQL_NORMAL} AS clean FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.normalize("text").alias("clean"))


@query("tokenize", f"SELECT doc_id, array_to_string({SQL_WORDS}, ' ') AS words FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", text.join_tokens(text.words("text")).alias("words"))


@query("stopword_filter", f"SELECT doc_id, array_to_string({SQL_TOKENS}, '|') AS tokens FROM documents")
def _(spark, folder):
    kept = text.drop_stop_words(text.words("text"), STOP)
    return documents(spark, folder).select("doc_id", F.array_join(kept, "|").alias("tokens"))


@query(
    "stopword_filter_notebook",
    f"SELECT doc_id, array_to_string([t for t in string_split({SQL_NORMAL}, ' ') if length(t) <> 1 and not list_contains({sql_list(STOP)}, t)], '|') AS tokens FROM documents",
)
def _(spark, folder):
    kept = text.drop_stop_words_study(F.split(text.normalize("text"), " "), STOP)
    return documents(spark, folder).select("doc_id", F.array_join(kept, "|").alias("tokens"))


@query(
    "stopword_default",
    f"""SELECT w AS word, count(*) AS n FROM (SELECT unnest({SQL_WORDS}) AS w FROM documents)
    WHERE list_contains({sql_list(ENGLISH)}, w) GROUP BY w""",
)
def _(spark, folder):
    words = documents(spark, folder).select(F.explode(text.words("text")).alias("word"))
    return words.where(F.col("word").isin(list(english_words()))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


DICTIONARY = "dictionary AS (SELECT DISTINCT w AS form, substring(w, 1, length(w) - 2) AS lemma FROM (SELECT unnest(tokens) AS w FROM docs) WHERE w LIKE '%ing')"


def dictionary_of(docs):
    forms = docs.select(F.explode("tokens").alias("form")).where(F.col("form").like("%ing")).distinct()
    return forms.select("form", F.expr("substring(form, 1, length(form) - 2)").alias("lemma"))


@query(
    "lemma_lookup",
    f"""{DOCS}, {DICTIONARY}, parts AS (SELECT doc_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM docs),
    joined AS (SELECT doc_id, i, trim(coalesce(lemma, w)) AS w FROM parts LEFT JOIN dictionary ON form = w)
    SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (w <> ''), '') AS lemmas FROM docs LEFT JOIN joined USING (doc_id) GROUP BY doc_id""",
)
def _(spark, folder):
    docs = tokens_of(spark, folder).select("doc_id", "tokens")
    return tokens.lemmatise(docs, dictionary_of(docs)).select("doc_id", text.join_tokens("tokens").alias("lemmas"))


@query(
    "stoptable_filter",
    f"""{DOCS}, listed AS (SELECT DISTINCT w FROM (SELECT unnest(tokens) AS w FROM docs) WHERE w LIKE 'th%')
    SELECT doc_id, array_to_string([t for t in tokens if t NOT LIKE 'th%'], ' ') AS tokens FROM docs""",
)
def _(spark, folder):
    docs = tokens_of(spark, folder).select("doc_id", "tokens")
    listed = docs.select(F.explode("tokens").alias("word")).where(F.col("word").like("th%")).distinct()
    return tokens.filter_by_stop_table(docs, listed, literal_words=10).select("doc_id", text.join_tokens("tokens").alias("tokens"))


@query("tokens_join", f"{DOCS} SELECT doc_id, array_to_string(tokens, ' ') AS processed_text_str FROM docs")
def _(spark, folder):
    return tokens_of(spark, folder).select("doc_id", text.join_tokens("tokens").alias("processed_text_str"))


@query(
    "stoplist_union",
    f"""SELECT DISTINCT word FROM (SELECT lower(s_name) AS word FROM supplier UNION ALL SELECT lower(c_name) FROM customer
    UNION ALL SELECT unnest({sql_list(STOP)}) UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)""",
)
def _(spark, folder):
    named = [table(spark, folder, t).select(F.lower(c).alias("word")) for t, c in (("supplier", "s_name"), ("customer", "c_name"))]
    pieces = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return tokens.stop_list_union(*named, files.word_table(spark, STOP), pieces)


@query("name_plurals", "SELECT lower(c_name) || s AS word FROM customer, (SELECT unnest(['', 's']) AS s)")
def _(spark, folder):
    return tokens.name_plurals(table(spark, folder, "customer"), "c_name")


@query("vocab_size", f"{DOCS} SELECT count(DISTINCT w) AS vocab_size FROM (SELECT unnest(tokens) AS w FROM docs)")
def _(spark, folder):
    return tokens.vocabulary_size(tokens_of(spark, folder))


@query(
    "adaptive_min_df",
    f"{DOCS} SELECT lang, vocab_size, CAST(CASE WHEN vocab_size < 100 THEN 1 ELSE 2 END AS INTEGER) AS min_df FROM (SELECT lang, count(DISTINCT w) AS vocab_size FROM (SELECT lang, unnest(tokens) AS w FROM docs) GROUP BY lang)",
)
def _(spark, folder):
    words = tokens_of(spark, folder).select("lang", F.explode(F.array_distinct("tokens")).alias("w")).distinct()
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("vocab_size"))
    return sizes.withColumn("min_df", weights.adaptive_min_df(F.col("vocab_size")))


@query("ellipsis", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS summary, substring(text, 1, 80) || '...' AS report FROM documents")
def _(spark, folder):
    return documents(spark, folder).select(
        "doc_id", text.ellipsis("text", 100).alias("summary"), text.ellipsis("text", 80, always=True).alias("report")
    )


# --- corpus checks -------------------------------------------------------------------------------


@query("text_length_stats", "SELECT round(avg(length(text)), 6) AS mean, median(length(text)) AS median, min(length(text)) AS min, max(length(text)) AS max FROM documents")
def _(spark, folder):
    return corpus.length_stats(documents(spark, folder), F.length("text")).withColumn("mean", F.round("mean", 6))


@query("token_count_stats", f"{DOCS} SELECT round(avg(len(tokens)), 6) AS mean, median(len(tokens)) AS median, min(len(tokens)) AS min, max(len(tokens)) AS max FROM docs")
def _(spark, folder):
    return corpus.length_stats(tokens_of(spark, folder), F.size("tokens")).withColumn("mean", F.round("mean", 6))


@query("min_length_filter", "SELECT doc_id, length(text) AS text_length FROM documents WHERE length(text) >= 200")
def _(spark, folder):
    sized = documents(spark, folder).select("doc_id", F.length("text").cast("bigint").alias("text_length"))
    return corpus.at_least(sized, F.col("text_length"), 200)


@query("min_length_removed", "SELECT count(*) FILTER (length(text) >= 200) AS kept, count(*) FILTER (length(text) < 200) AS removed FROM documents")
def _(spark, folder):
    return corpus.removed_count(documents(spark, folder), F.length("text"), 200)


@query("min_token_filter", f"{DOCS} SELECT doc_id, len(tokens) AS token_count FROM docs WHERE len(tokens) >= 10")
def _(spark, folder):
    counted = tokens_of(spark, folder).select("doc_id", F.size("tokens").cast("bigint").alias("token_count"))
    return corpus.at_least(counted, F.col("token_count"), 10)


@query("min_token_removed", f"{DOCS} SELECT count(*) FILTER (len(tokens) >= 10) AS kept, count(*) FILTER (len(tokens) < 10) AS removed FROM docs")
def _(spark, folder):
    return corpus.removed_count(tokens_of(spark, folder), F.size("tokens"), 10)


@query("doc_preview", f"{DOCS} SELECT doc_id, substring(text, 1, 200) AS start, array_to_string(tokens[1:20], ' ') AS first_tokens FROM docs ORDER BY doc_id LIMIT 3")
def _(spark, folder):
    return corpus.preview(
        tokens_of(spark, folder), "doc_id", 3, F.substring("text", 1, 200).alias("start"), F.array_join(F.slice("tokens", 1, 20), " ").alias("first_tokens")
    )


@query("row_slice", "SELECT doc_id, row_index, length(text) AS n FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) WHERE row_index BETWEEN 50 AND 149")
def _(spark, folder):
    part = corpus.row_slice(documents(spark, folder), "doc_id", 50, 150)
    return part.select("doc_id", "row_index", F.length("text").cast("bigint").alias("n"))


@query("point_lookup", "SELECT source FROM documents WHERE doc_id = 150")
def _(spark, folder):
    return corpus.point_lookup(documents(spark, folder), "doc_id", 150, "source")


@query("corpus_shape", "SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_columns FROM documents")
def _(spark, folder):
    return corpus.shape(documents(spark, folder))


@query("concat_batches", "SELECT doc_id, lang, length(text) AS n FROM documents")
def _(spark, folder):
    docs = documents(spark, folder).select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))
    return corpus.concat_tables(*[docs.where(F.pmod("doc_id", F.lit(3)) == r) for r in range(3)])


@query("concat_sources", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def _(spark, folder):
    return corpus.concat_sources(
        table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment"),
        table(spark, folder, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_nationkey AS nation"),
    )


@query(
    "preprocess_documents",
    f"{DOCS} SELECT doc_id, length(text) AS text_length, len(tokens) AS token_count, array_to_string(tokens, ' ') AS processed_text_str FROM docs WHERE length(text) >= 200 AND len(tokens) >= 10",
)
def _(spark, folder):
    docs = spread_small(documents(spark, folder).select("doc_id", "text"))
    cleaned = clean_documents(docs, CleanParams(stop_words=STOP), "text")
    return cleaned.select("doc_id", "text_length", "token_count", "processed_text_str")


@query(
    "run_report",
    f"""{DOCS}, measures AS (SELECT 'text_length' AS measure, length(text) AS v, 200 AS least FROM docs
      UNION ALL SELECT 'token_count', len(tokens), 10 FROM docs WHERE length(text) >= 200)
    SELECT measure, count(*) AS n, count(*) FILTER (WHERE v >= least) AS kept, count(*) - count(*) FILTER (WHERE v >= least) AS removed,
      avg(v) AS mean, quantile_disc(v, 0.5) AS median, min(v) AS min, max(v) AS max FROM measures GROUP BY measure""",
)
def _(spark, folder):
    docs = spread_small(documents(spark, folder).select("doc_id", "text"))
    cleaned, seen = watched_cleaning(docs, CleanParams(stop_words=STOP), "text")
    materialise(cleaned, "cleaned")
    return stats_table(docs, seen)


# --- sources and sinks ---------------------------------------------------------------------------


def _folder(spark, label):
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@query("stage_roundtrip", "SELECT 'https://example.org/' || doc_id AS case_url, CAST(doc_id AS VARCHAR) AS docket, text AS case_text FROM documents")
def _(spark, folder):
    store = StageStore(spark, _folder(spark, "stages"))
    build = lambda: documents(spark, folder).selectExpr(
        "concat('https://example.org/', doc_id) AS case_url", "cast(doc_id AS string) AS docket", "text AS case_text"
    )
    store.get_or_build("full_cases", build)
    return store.get_or_build("full_cases", lambda: build().limit(0))


@query(
    "batch_assign",
    """SELECT doc_id, row_index, (row_index - row_index % 300) || '_' || least(row_index - row_index % 300 + 300, n) AS batch
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index, count(*) OVER () AS n FROM documents)""",
)
def _(spark, folder):
    return assign_batches(documents(spark, folder), "doc_id", 300)


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, folder):
    path = _folder(spark, "csv")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    files.write_csv(customer, path)
    return files.read_csv(spark, path, customer.schema)


SQL_LATIN = "regexp_replace(text, '[^\\x{20}-\\x{7E}\\x{A1}-\\x{FF}\\n]', '', 'g')"


@query("csv_latin1_roundtrip", f"SELECT doc_id, 'x' || {SQL_LATIN} || 'x' AS text FROM documents")
def _(spark, folder):
    path = _folder(spark, "latin1")
    plain = F.regexp_replace("text", "[^\\x20-\\x7E\\xA1-\\xFF\\n]", "")
    docs = documents(spark, folder).select("doc_id", F.concat(F.lit("x"), plain, F.lit("x")).alias("text"))
    files.write_csv(docs, path, files.LATIN1)
    return files.read_csv(spark, path, docs.schema, files.LATIN1)


@query(
    "topic_words_json",
    """SELECT '{' || string_agg('"' || k || '":"' || words || '"', ',' ORDER BY k) || '}' AS json
    FROM (SELECT p_size % 20 AS k, string_agg(p_name, ', ' ORDER BY p_partkey) AS words FROM part GROUP BY 1)""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    named = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda e: e["p_name"])
    words = part.groupBy((F.col("p_size") % 20).cast("int").alias("topic_number")).agg(F.array_join(named, ", ").alias("topic_words"))
    return files.topic_words_object(words)


# --- term weights --------------------------------------------------------------------------------

TF = "tf AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS w FROM docs) WHERE length(w) >= 2 GROUP BY 1, 2)"
N = "(SELECT count(*) FROM documents)"


def sql_fitted(max_df, min_df, cap=None, stop=()):
    """CTEs ``kept`` (the vocabulary) and ``weighted`` for given settings."""
    allowed = f"WHERE NOT list_contains({sql_list(stop)}, term)" if stop else ""
    limit = f"ORDER BY total DESC, term LIMIT {cap}" if cap else ""
    return f"""stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term),
    pruned AS (SELECT * FROM stats {allowed}), bounded AS (SELECT * FROM pruned WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * {N} {limit}),
    kept AS (SELECT *, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, ln((1.0::DOUBLE + {N}) / (1.0::DOUBLE + df)) + 1 AS idf FROM bounded),
    raw AS (SELECT doc_id, term, term_id, tf * idf AS x FROM tf JOIN kept USING (term)),
    weighted AS (SELECT doc_id, term, term_id, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def fitted(spark, folder, params):
    docs = materialise(tokens_of(spark, folder).select("doc_id", "lang", "tokens"), "tokens")
    return docs, weights.fit_weights(docs, params)


def named_weights(docs, fit):
    return fit.weighted(docs).join(fit.vocabulary.select("term_id", "term"), "term_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("term_counts", f"{DOCS}, {TF} SELECT doc_id, term, tf FROM tf")
def _(spark, folder):
    return weights.term_counts(tokens_of(spark, folder))


@query("term_counts_stop", f"{DOCS}, {TF} SELECT doc_id, term, tf FROM tf WHERE NOT list_contains({sql_list(SECOND_STOP)}, term)")
def _(spark, folder):
    return weights.term_counts(tokens_of(spark, folder), stop_words=SECOND_STOP)


@query("term_stats", f"{DOCS}, {TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term")
def _(spark, folder):
    return weights.term_stats(tokens_of(spark, folder))


@query("df_prune", f"{DOCS}, {TF}, {sql_fitted(0.3, 5)} SELECT term, df FROM bounded")
def _(spark, folder):
    docs = tokens_of(spark, folder)
    return weights.prune_by_df(weights.term_stats(docs), docs.count(), 5, 0.3).select("term", "df")


@query("feature_cap", f"{DOCS}, {TF}, {sql_fitted(0.95, 2, 500)} SELECT term, total FROM bounded")
def _(spark, folder):
    docs = tokens_of(spark, folder)
    return weights.cap_features(weights.prune_by_df(weights.term_stats(docs), docs.count(), 2, 0.95), 500).select("term", "total")


@query("vocab_index", f"{DOCS}, {TF}, {sql_fitted(0.95, 2, 500)} SELECT term, term_id FROM kept")
def _(spark, folder):
    return fitted(spark, folder, weights.WeightParams(0.95, 2, 500))[1].vocabulary.select("term", "term_id")


@query("vocab_index_uncapped", f"{DOCS}, {TF}, {sql_fitted(0.8, 2)} SELECT term, term_id FROM kept")
def _(spark, folder):
    return fitted(spark, folder, weights.STUDY_LSA)[1].vocabulary.select("term", "term_id")


@query("idf", f"{DOCS}, {TF}, {sql_fitted(0.95, 2, 5000)} SELECT term, round(idf, 6) AS idf FROM kept")
def _(spark, folder):
    return fitted(spark, folder, weights.STANDARD)[1].vocabulary.select("term", F.round("idf", 6).alias("idf"))


@query("tfidf", f"{DOCS}, {TF}, {sql_fitted(0.95, 2, 5000, SECOND_STOP)} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def _(spark, folder):
    return named_weights(*fitted(spark, folder, weights.WeightParams(stop_words=SECOND_STOP)))


@query("tfidf_joined", f"{DOCS}, {TF}, {sql_fitted(0.95, 2, 5000, SECOND_STOP)} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def _(spark, folder):
    return named_weights(*fitted(spark, folder, weights.WeightParams(stop_words=SECOND_STOP, local_terms=0)))


@query("tfidf_notebook", f"{DOCS}, {TF}, {sql_fitted(0.8, 5)} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def _(spark, folder):
    return named_weights(*fitted(spark, folder, weights.STUDY_FINAL))


@query("tfidf_fallback", f"{DOCS}, {TF}, {sql_fitted(0.99, 1, 1000)} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted")
def _(spark, folder):
    return named_weights(*fitted(spark, folder, weights.WeightParams(0.95, 1_000_000_000, 5000, SECOND_STOP)))


FIT_EN = sql_fitted(0.95, 2, 5000).replace("FROM tf GROUP BY term", "FROM tf JOIN docs USING (doc_id) WHERE lang = 'en' GROUP BY term").replace(N, "(SELECT count(*) FROM documents WHERE lang = 'en')")


@query("tfidf_transform", f"{DOCS}, {TF}, {FIT_EN} SELECT doc_id, term, round(weight, 6) AS weight FROM weighted JOIN docs USING (doc_id) WHERE lang <> 'en'")
def _(spark, folder):
    docs = materialise(tokens_of(spark, folder).select("doc_id", "lang", "tokens"), "tokens")
    fit = weights.fit_weights(docs.where("lang = 'en'"), weights.STANDARD)
    return named_weights(docs.where("lang <> 'en'"), fit)


@query(
    "topic_top_words",
    f"""{DOCS}, {TF}, {sql_fitted(0.95, 2, 5000)}, sums AS (SELECT lang, term, round(sum(weight), 6) AS weight FROM weighted JOIN docs USING (doc_id) GROUP BY 1, 2),
    topics AS (SELECT CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS topic_number, term, weight FROM sums),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_number ORDER BY weight DESC, term) AS r FROM topics)
    SELECT topic_number, string_agg(term, ', ' ORDER BY r) AS topic_words FROM ranked WHERE r <= 40 GROUP BY 1""",
)
def _(spark, folder):
    from topicloom.operators.topics import top_words

    docs, fit = fitted(spark, folder, weights.STANDARD)
    sums = fit.weighted(docs).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "term_id").agg(F.round(F.sum("weight"), 6).alias("weight"))
    named = sums.join(fit.vocabulary.select("term_id", "term"), "term_id")
    languages = {r[0]: i for i, r in enumerate(docs.select("lang").distinct().orderBy("lang").collect())}
    number = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])[F.col("lang")]
    return top_words(named.select(number.alias("topic_number"), "term", "weight"), 40)
