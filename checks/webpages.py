"""Links and text out of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, sql_list, table
from topicloom.functions.urls import docket, docket_digits
from topicloom.operators import content, links
from topicloom.plans.collect import collect_links, extract_text
from topicloom.runtime import spread_small

MARKER, EXCLUDE = "/en/", "utm_source"

# The given pages link to nothing with a number, so each also gets a link to its own address.
SQL_LINKED = """linked AS (SELECT page_id, url, html || '<a class="case" href="' || url || '">Page <b>' || page_id || '</b> of ' || url || '</a>' AS html FROM pages),
tagged AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\\s.*?</a>') AS tags FROM linked),
tags AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS position FROM tagged)"""


def _unescaped(sql: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


SQL_HREF = _unescaped("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")
SQL_TEXT = _unescaped("trim(regexp_replace(tag, '\\s*<[^>]*>\\s*', '', 'g'))")
SQL_LINKS = f"{SQL_LINKED}, links AS (SELECT page_id, CAST(position AS INTEGER) AS position, tag, {SQL_HREF} AS href, {SQL_TEXT} AS text FROM tags)"
SQL_DOCKET = "regexp_replace(replace(list_last(string_split(rtrim({0}, '/'), '/')), '.html', ''), '[^0-9-]', '', 'g')"
SQL_MATCHED = f"""{SQL_LINKS}, matched AS (SELECT *, {SQL_DOCKET.format('href')} AS docket FROM links
  WHERE contains(href, '{MARKER}') AND NOT contains(href, '{EXCLUDE}') AND {SQL_DOCKET.format('href')} <> '')"""


def pages(spark, folder):
    return table(spark, folder, "pages")


def linked(spark, folder):
    own = F.concat(
        F.lit('<a class="case" href="'), "url", F.lit('">Page <b>'), F.col("page_id").cast("string"), F.lit("</b> of "), "url", F.lit("</a>")
    )
    return pages(spark, folder).select("page_id", "url", F.concat("html", own).alias("html"))


@query("scan_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def _(spark, folder):
    from topicloom.sources.pages import scan_pages

    return scan_pages(spark, f"{folder}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("links_extract", f"WITH {SQL_LINKS} SELECT page_id, position, href, text FROM links")
def _(spark, folder):
    return links.explode_anchors(linked(spark, folder)).drop("tag")


@query("case_link_filter", f"WITH {SQL_MATCHED} SELECT page_id, href, docket FROM matched")
def _(spark, folder):
    return links.case_links(links.explode_anchors(linked(spark, folder)), MARKER, EXCLUDE).select("page_id", "href", "docket")


@query(
    "case_link_filter_tag",
    f"""WITH {SQL_LINKS} SELECT page_id, href, regexp_replace(list_last(string_split(href, '/')), '[^0-9]', '', 'g') AS docket FROM links
    WHERE regexp_matches(tag, 'case') AND NOT regexp_matches(tag, 'utm_source') AND NOT regexp_matches(tag, '/fr/')""",
)
def _(spark, folder):
    found = links.case_links_study(links.explode_anchors(linked(spark, folder)), "case", "utm_source", "/fr/")
    return found.select("page_id", "href", "docket")


@query("docket_extract", f"SELECT url, {SQL_DOCKET.format('url')} AS docket FROM pages WHERE {SQL_DOCKET.format('url')} <> ''")
def _(spark, folder):
    return pages(spark, folder).select("url", docket(F.col("url")).alias("docket")).where("docket <> ''")


@query("docket_extract_digits", "SELECT url, regexp_replace(list_last(string_split(url, '/')), '[^0-9]', '', 'g') AS docket FROM pages")
def _(spark, folder):
    return pages(spark, folder).select("url", docket_digits(F.col("url")).alias("docket"))


@query("links_distinct", f"SELECT DISTINCT url AS case_url, {SQL_DOCKET.format('url')} AS docket FROM pages")
def _(spark, folder):
    return links.distinct_links(pages(spark, folder).select(F.col("url").alias("href"), docket(F.col("url")).alias("docket")))


@query("links_per_page", f"WITH {SQL_MATCHED} SELECT page_id, (SELECT count(*) FROM matched WHERE matched.page_id = pages.page_id) AS n_links FROM pages")
def _(spark, folder):
    return links.links_per_page(linked(spark, folder), MARKER, EXCLUDE)


@query("links_total", f"WITH {SQL_MATCHED} SELECT count(DISTINCT href) AS n_links FROM matched")
def _(spark, folder):
    return links.link_total(links.case_links(links.explode_anchors(linked(spark, folder)), MARKER, EXCLUDE))


@query(
    "link_preview",
    f"""WITH {SQL_LINKS.replace("href=", "href=")}, ranked AS (SELECT *, {SQL_DOCKET.format("href || '1'")} AS docket0, row_number() OVER (PARTITION BY page_id ORDER BY position) AS r
      FROM links WHERE contains(href, 'e') AND NOT contains(href, 'utm_source') AND {SQL_DOCKET.format('href')} <> '')
    SELECT page_id, CAST(r AS INTEGER) AS rank, href, {SQL_DOCKET.format('href')} AS docket, substring(text, 1, 50) AS title FROM ranked WHERE r <= 3""",
)
def _(spark, folder):
    return links.link_preview(linked(spark, folder), "e", EXCLUDE)


@query(
    "link_pattern_profile",
    f"""WITH {SQL_LINKS}, tests AS (
      SELECT page_id, position, href, text, 'word' AS pattern, contains(href, 'example') AS ok FROM links
      UNION ALL SELECT page_id, position, href, text, 'number', regexp_matches(href, '\\d+-\\d+') FROM links
      UNION ALL SELECT page_id, position, href, text, 'phrase', contains(text, 'th') FROM links),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, pattern ORDER BY position) AS r FROM tests WHERE ok)
    SELECT p.page_id, k.pattern, count(r) AS matches, coalesce(string_agg(href || ' | ' || substring(text, 1, 80), '; ' ORDER BY r) FILTER (r <= 5), '') AS samples
    FROM pages p CROSS JOIN (SELECT unnest(['word', 'number', 'phrase']) AS pattern) k LEFT JOIN ranked ON ranked.page_id = p.page_id AND ranked.pattern = k.pattern
    GROUP BY 1, 2""",
)
def _(spark, folder):
    profile = links.link_patterns(linked(spark, folder), "example", "th")
    return profile.withColumn("samples", F.array_join("samples", "; "))


@query(
    "page_profile",
    f"""SELECT page_id, {_unescaped("coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'No title')")} AS title,
    len(regexp_extract_all(html, '<(div|section) class="[^"]*(ad|case)[^"]*"')) AS containers FROM pages""",
)
def _(spark, folder):
    return links.page_profile(pages(spark, folder), "ad|case")


@query("collect_links", f"WITH {SQL_MATCHED} SELECT DISTINCT href AS case_url, docket FROM matched")
def _(spark, folder):
    return collect_links(linked(spark, folder), MARKER, EXCLUDE)


# No page holds a selected container, so the paragraph rule decides; where no paragraph is long enough, the
# whole page does.  Scripts, styles and comments become a tag: they separate text nodes but show nothing.
ENDERS = "p|div|article|section|ul|ol|li|h1|h2|h3|nav|footer|body|html"
SQL_PARTS = f"""seen AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<i>', 'g'), '<p(\\s[^>]*)?>', '<p>', 'g') AS html FROM pages),
cut AS (SELECT page_id, unnest((string_split(html, '<p>'))[2:]) AS piece, generate_subscripts((string_split(html, '<p>'))[2:], 1) AS i FROM seen),
ended AS (SELECT page_id, i, regexp_replace(piece, '(?s)</?({ENDERS})(\\s[^>]*)?>.*$', '') AS piece FROM cut),
nodes AS (SELECT page_id, i, {_unescaped("regexp_replace(regexp_replace(piece, '\\s*(<[^>]*>\\s*)+', '', 'g'), '^\\s+|\\s+$', '', 'g')")} AS t FROM ended),
joined AS (SELECT page_id, string_agg(t, ' ' ORDER BY i) AS t FROM nodes WHERE length(t) > 50 GROUP BY page_id),
whole AS (SELECT page_id, {_unescaped("replace(replace(trim(regexp_replace(regexp_replace(html, '\\s*(<[^>]*>\\s*)+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), '&copy;', '©'), '&middot;', '·')")} AS t FROM seen),
texts AS (SELECT whole.page_id, coalesce(joined.t, CASE WHEN length(whole.t) > 200 THEN whole.t ELSE '' END) AS case_text,
  CASE WHEN joined.t IS NOT NULL THEN 'paragraph' WHEN length(whole.t) > 200 THEN 'page' ELSE 'none' END AS rule FROM whole LEFT JOIN joined USING (page_id))"""


@query("page_text", f"WITH {SQL_PARTS} SELECT page_id, case_text, rule FROM texts")
def _(spark, folder):
    return content.page_text(spread_small(pages(spark, folder)))


@query("page_text_rules", f"WITH {SQL_PARTS} SELECT rule, count(*) AS n FROM texts GROUP BY rule")
def _(spark, folder):
    found = content.page_text(spread_small(pages(spark, folder)))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_text_exact",
    f"""SELECT page_id, coalesce({_unescaped("string_agg(regexp_replace(t, '<[^>]*>', '', 'g'), ' ')")}, '') AS case_text
    FROM (SELECT page_id, unnest(CASE WHEN len(m) = 0 THEN [NULL] ELSE m END) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1) AS m FROM pages)) GROUP BY page_id""",
)
def _(spark, folder):
    return content.page_text_exact(pages(spark, folder), class_value="ad").drop("rule")


@query(
    "page_text_selected",
    f"""SELECT page_id, {_unescaped("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1), '\\s*(<[^>]*>\\s*)+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")} AS case_text
    FROM pages WHERE length({_unescaped("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1), '\\s*(<[^>]*>\\s*)+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")}) > 100""",
)
def _(spark, folder):
    found = content.page_text(pages(spark, folder), selectors=(content.Selector(classes=("ad",)),))
    return found.where("rule = 'selector'").select("page_id", "case_text")


@query(
    "extract_text",
    f"""WITH {SQL_PARTS}, cases AS (SELECT DISTINCT url AS case_url, {SQL_DOCKET.format('url')} AS docket FROM pages)
    SELECT case_url, docket, case_text FROM cases JOIN pages ON url = case_url JOIN texts USING (page_id)""",
)
def _(spark, folder):
    crawled = spread_small(pages(spark, folder))
    cases = links.distinct_links(crawled.select(F.col("url").alias("href"), docket(F.col("url")).alias("docket")))
    return extract_text(cases, crawled)
