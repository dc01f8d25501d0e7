"""The registered queries over the reference's own operators, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenpage.functions import text as T
from lumenpage.operators import documents as D
from lumenpage.operators.remediate import repaired, violations
from lumenpage.operators.rules import RULES, findings
from lumenpage.plans import cases, dims, report
from lumenpage.sources.elements import elements, page_table, spread

QUERIES, ORACLE_SQL = dict(cases.QUERIES), dict(cases.ORACLE_SQL)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_table(spread(table(spark, sf_dir, "pages")))


def scanned(own: DataFrame, course_rules: bool = False, only: set[str] | None = None) -> DataFrame:
    """Issues, kept for the several aggregates over them, as each would parse the pages again."""
    return report.issues(own, course_rules, only=only).persist(StorageLevel.MEMORY_AND_DISK)


HOST = r"regexp_extract(url, '^https?://([^/]+)', 1)"


#: What the rules that can fire on these pages count, from the source alone: top headings; pages without others; short bold paragraphs; links of one text and several addresses; formulas.
_BODY = r"regexp_extract(html, '(?s)<body[^>]*>(.*)', 1)"
_SHOWN = rf"html_unescape(regexp_replace(regexp_replace({_BODY}, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'))"
PAGE_ISSUES = rf"""
    h AS (SELECT page_id, {HOST} AS course_id, html, replace(replace(replace(replace({_SHOWN.replace('html_unescape', '')}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS shown,
      string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p><b>') AS cut FROM pages),
    b AS (SELECT page_id, count(*) AS n FROM (SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(array_to_string(cut[j:], ''), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS bold
      FROM (SELECT page_id, cut, unnest(range(2, len(cut) + 1)) AS j FROM h)) WHERE length(bold) BETWEEN 1 AND 80 GROUP BY 1),
    a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*"[^>]*>.*?</a>')) AS tag FROM pages),
    l AS (SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, lower(trim(regexp_extract(tag, '(?s)>(.*)</a>', 1))) AS text FROM a),
    g AS (SELECT page_id, text FROM l WHERE text <> '' AND href <> '' GROUP BY 1, 2 HAVING count(DISTINCT href) > 1),
    m AS (SELECT l.page_id, count(*) AS n FROM l JOIN g ON l.page_id = g.page_id AND l.text = g.text GROUP BY 1),
    i AS (SELECT h.page_id, course_id, len(regexp_extract_all(html, '<h1[ >]')) AS tops,
      CASE WHEN NOT regexp_matches(html, '<h[2-6][ >]') AND length(regexp_replace(shown, '\s', '', 'g')) > 50 THEN 1 ELSE 0 END AS bare,
      coalesce(b.n, 0) AS bolds, coalesce(m.n, 0) AS ambiguous,
      CASE WHEN regexp_matches(shown, '(?s)\$\$.+?\$\$') THEN 1 ELSE 0 END AS formulas FROM h LEFT JOIN m ON m.page_id = h.page_id LEFT JOIN b ON b.page_id = h.page_id),
    c AS (SELECT course_id, count(*) AS pages, sum(tops)::BIGINT AS errors, sum(bare + bolds + ambiguous + formulas)::BIGINT AS warnings FROM i GROUP BY 1)
"""


@query(
    f"""
    WITH {PAGE_ISSUES}, s AS (SELECT *, round_even(100 * exp(-((errors + 0.25 * warnings) / pages) / 4.0), 1) AS score FROM c)
    SELECT course_id, pages AS pages_analyzed, errors + warnings AS total_issues, errors, warnings, 0::BIGINT AS info, 0::BIGINT AS images_needing_alt, score,
      CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'needs_work' ELSE 'poor' END AS band FROM s
    """
)
def course_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: issues of every rule, then counts, score and band per course."""
    own = pages(spark, sf_dir)
    return report.course_report(own, report.issues(own))


@query(
    f"""
    SELECT {HOST} AS course_id, count(*) AS pages, sum(len(regexp_extract_all(html, '<h1[ >]')))::BIGINT AS errors,
      round_even(100 * exp(-(sum(len(regexp_extract_all(html, '<h1[ >]'))) / count(*)) / 4.0), 1) AS score
    FROM pages GROUP BY 1
    """
)
def course_error_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of errors alone."""
    own = pages(spark, sf_dir)
    out = report.course_report(own, report.issues(own, only={r.rule_id for r in RULES if r.severity == "error"}))
    return out.select("course_id", F.col("pages_analyzed").alias("pages"), "errors", "score")


@query("SELECT page_id, len(regexp_extract_all(html, '<h1[ >]'))::BIGINT AS h1_issues FROM pages")
def h1_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of one rule per page, of pages without any as well."""
    own = pages(spark, sf_dir)
    found = report.page_counts(own, report.issues(own, only={"HDG001"}))
    return found.select(F.col("page_id").cast("long").alias("page_id"), F.col("issues").alias("h1_issues"))


@query(
    """
    SELECT page_id FROM pages
    WHERE NOT regexp_matches(html, '<h[2-6][ >]')
      AND length(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '\\s', '', 'g')) > 50
    """
)
def pages_without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(elements(pages(spark, sf_dir)), only={"HDG005"})
    return found.select(F.col("page_id").cast("long").alias("page_id"))


@query(
    """
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*"[^>]*>.*?</a>')) AS tag FROM pages),
    l AS (SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(tag, '(?s)>(.*)</a>', 1)) AS text FROM a),
    g AS (SELECT page_id, lower(text) AS t FROM l WHERE text <> '' AND href <> '' GROUP BY 1, 2 HAVING count(DISTINCT href) > 1)
    SELECT l.page_id, lower(l.text) AS link_text, count(*) AS issues FROM l JOIN g ON l.page_id = g.page_id AND lower(l.text) = g.t GROUP BY 1, 2
    """
)
def ambiguous_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with one text and several destinations."""
    found = findings(elements(pages(spark, sf_dir)), only={"LNK010"})
    text = F.lower(F.regexp_extract("message", '^Multiple links with text "(.*)" point to different', 1))
    return found.groupBy(F.col("page_id").cast("long").alias("page_id"), text.alias("link_text")).agg(F.count("*").alias("issues"))


@query(
    """
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM a GROUP BY 1
    """
)
def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address that pages link to."""
    links = elements(pages(spark, sf_dir), facts=False).where("tag = 'a'").select("page_id", F.col("attrs")["href"].alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query(
    f"""
    WITH h AS (SELECT {HOST} AS course_id, page_id, len(regexp_extract_all(html, '<h1[ >]')) AS n FROM pages),
    c AS (SELECT course_id, count(*) AS pages, count(*) FILTER (n > 0) AS affected, sum(n)::BIGINT AS issues FROM h GROUP BY 1),
    d AS (SELECT unnest(['{"', '".join(r[0] for r in dims.criteria_rows())}']) AS criterion_id)
    SELECT course_id, criterion_id, CASE WHEN criterion_id = '1.3.1' THEN issues ELSE 0 END AS issue_count,
      CASE WHEN criterion_id = '1.3.1' THEN affected ELSE 0 END AS pages_affected,
      CASE WHEN criterion_id <> '1.3.1' OR issues = 0 THEN 'Supports' WHEN affected = pages THEN 'Does Not Support' ELSE 'Partially Supports' END AS conformance
    FROM c, d
    """
)
def criteria_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformance by course and criterion, of one rule's issues."""
    own = pages(spark, sf_dir)
    out = report.criteria_rollup(own, scanned(own, only={"HDG001"}))
    return out.select("course_id", "criterion_id", "issue_count", "pages_affected", "conformance")


@query()
def conformance_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conformance report per course, as Markdown."""
    own = pages(spark, sf_dir)
    return report.acr_markdown(report.acr(own, scanned(own, course_rules=True)))


@query()
def repair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues before and after repairs, per course."""
    own = pages(spark, sf_dir)
    before = scanned(own)
    new = repaired(own, before).persist(StorageLevel.MEMORY_AND_DISK)
    after = report.issues(new.select(own.columns))
    count = lambda df, name: df.groupBy("course_id", "page_id").agg(F.count("*").alias(name))
    rows = new.select("course_id", "page_id", "changed").join(count(before, "b"), ["course_id", "page_id"], "left").join(count(after, "a"), ["course_id", "page_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return report.run_summary(rows.select("course_id", "changed", zero("b").alias("issues_before"), zero("a").alias("issues_after")))


@query(
    """
    SELECT page_id, count(*) AS forbidden FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<(h1|style|script|meta|link|form|input|button|font|center)[ >]')) FROM pages) GROUP BY 1
    """
)
def sanitizer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = violations(elements(pages(spark, sf_dir), facts=False)).where("severity = 'error'")
    return found.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count("*").alias("forbidden"))


@query(
    """
    WITH k AS (SELECT p_partkey, p_size % 3 AS m FROM part)
    SELECT p_partkey AS page_id, rule, count(*) AS issues FROM (
      SELECT p_partkey, unnest(CASE m WHEN 2 THEN ['IMG002', 'IMG009'] ELSE ['IMG001'] END || ['LNK009', 'LNK001', 'LNK004', 'TBL001', 'TBL005', 'TBL006', 'STR002', 'DID001', 'CLR001']) AS rule FROM k)
    GROUP BY ALL
    """
)
def constructed_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over pages made of part rows, whose findings follow from the columns."""
    part = spread(table(spark, sf_dir, "part"))
    alt = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, ' alt=""').otherwise(F.concat(F.lit(' alt="photo of '), "p_name", F.lit('"')))
    html = F.concat(
        F.lit("<h2>"), "p_name", F.lit('</h2><p><img src="x.png"'), alt, F.lit('></p><a href="#">here</a><table><tr><td>1</td><td></td></tr></table><center>c</center>'),
        F.lit('<div id="a">x</div><div id="a">y</div><p style="color: #cccccc; background-color: #ffffff">pale</p>'),
    )
    null = F.lit(None).cast("string")
    made = part.select(F.lit("parts").alias("course_id"), F.col("p_partkey").cast("string").alias("page_id"), null.alias("identifier"), F.col("p_name").alias("title"), F.lit("wiki_page").alias("content_type"), null.alias("canvas_url"), html.alias("html"))
    return findings(elements(made)).groupBy(F.col("page_id").cast("long").alias("page_id"), "rule").agg(F.count("*").alias("issues"))


_ALTS = "CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.png' WHEN 2 THEN 'image of ' || p_name WHEN 3 THEN 'a' || p_partkey WHEN 4 THEN repeat(p_name || ' ', 12) ELSE '  ' END"


@query(
    f"""
    WITH a AS (SELECT p_partkey, trim({_ALTS}) AS alt FROM part)
    SELECT p_partkey, CASE WHEN alt = '' THEN 'missing_alt' WHEN starts_with(lower(alt), 'image of') THEN 'generic_placeholder' WHEN ends_with(lower(alt), '.png') THEN 'filename'
      WHEN regexp_matches(alt, '^[a-z]+[0-9]+$') THEN 'reference_code' WHEN length(alt) > 100 THEN 'too_long' END AS reason FROM a
    """
)
def alt_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why alternative texts are inadequate."""
    return table(spark, sf_dir, "part").select("p_partkey", T.inadequate_alt(F.expr(_ALTS)).alias("reason"))


@query(
    """
    WITH a AS (SELECT p_partkey, trim(regexp_replace(repeat(p_name || ' ' || p_type || ' ', 1 + p_size % 7), '\\s+', ' ', 'g')) AS alt FROM part),
    h AS (SELECT *, alt[:100] AS head FROM a)
    SELECT p_partkey, CASE WHEN length(alt) <= 100 THEN alt
      WHEN position(' ' IN reverse(head)) > 0 AND 100 - position(' ' IN reverse(head)) > 70 THEN rtrim(head[:100 - position(' ' IN reverse(head))]) ELSE rtrim(head) END AS alt FROM h
    """
)
def truncated_alts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.expr("repeat(p_name || ' ' || p_type || ' ', 1 + p_size % 7)")
    return table(spark, sf_dir, "part").select("p_partkey", T.truncated_alt(alt).alias("alt"))


_LINEAR = "(CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END)"


def _sql_luminance(r: str, g: str, b: str) -> str:
    return f"(0.2126 * {_LINEAR.format(r)} + 0.7152 * {_LINEAR.format(g)} + 0.0722 * {_LINEAR.format(b)})"


@query(
    f"""
    WITH c AS (SELECT c_custkey, c_custkey % 256 AS r, (c_custkey * 7) % 256 AS g, (c_custkey * 13) % 256 AS b, (c_custkey * 31) % 256 AS s FROM customer),
    l AS (SELECT c_custkey, {_sql_luminance('r', 'g', 'b')} AS x, {_sql_luminance('s', 's', 's')} AS y FROM c)
    SELECT c_custkey, round((greatest(x, y) + 0.05) / (least(x, y) + 0.05), 6) AS ratio FROM l
    """
)
def contrast_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    color = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    grey = (key * 31) % 256
    ratio = T.contrast(color(key % 256, (key * 7) % 256, (key * 13) % 256), color(grey, grey, grey))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(ratio, 6).alias("ratio"))


@query(
    f"""
    WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 256 AS r, (c_custkey * 7) % 256 AS g, (c_custkey * 13) % 256 AS b, (c_custkey * 31) % 256 AS s FROM customer),
    l AS (SELECT *, {_sql_luminance('r', 'g', 'b')} AS x, {_sql_luminance('s', 's', 's')} AS y FROM c),
    t AS (SELECT *, CASE WHEN y > 0.18 THEN 0 ELSE 255 END AS e FROM l),
    i AS (
      SELECT k, 0 AS n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM t
      UNION ALL
      SELECT q.k, n + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
      FROM (SELECT p.k, n, lo, hi, (greatest(z, y) + 0.05) / (least(z, y) + 0.05) >= 4.5 AS ok FROM (
        SELECT i.k, n, lo, hi, y, {_sql_luminance('trunc(r + (e - r) * (lo + hi) / 2)', 'trunc(g + (e - g) * (lo + hi) / 2)', 'trunc(b + (e - b) * (lo + hi) / 2)')} AS z
        FROM i JOIN t ON i.k = t.k WHERE n < 30) p) q
    )
    SELECT t.k AS c_custkey, CASE WHEN (greatest(x, y) + 0.05) / (least(x, y) + 0.05) >= 4.5 THEN r ELSE trunc(r + (e - r) * hi) END::INTEGER AS red FROM t JOIN i ON i.k = t.k AND n = 30
    """
)
def contrast_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The red part of text colours moved until they reach 4.5:1."""
    key = F.col("c_custkey")
    color = lambda r, g, b: F.struct(*(c.cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))))
    grey = (key * 31) % 256
    rows = spread(table(spark, sf_dir, "customer")).select("c_custkey", color(key % 256, (key * 7) % 256, (key * 13) % 256).alias("fg"), color(grey, grey, grey).alias("bg"))
    return rows.select("c_custkey", T.adjusted(F.col("fg"), F.col("bg"), 4.5)["r"].alias("red"))


@query(
    """
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(\\S*/)?([^/\\s"'']+\\.imscc)', '<imscc-dir>/\\2', 'g'),
      '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', '<email>', 'g'), '(?i)/Users/[^/\\s]+|/home/[^/\\s]+', '<home>', 'g')) AS scrubbed_md5 FROM documents
    """
)
def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.scrubbed(F.col("text")).cast("binary")).alias("scrubbed_md5"))


@query(
    """
    SELECT s_suppkey, trim(regexp_replace(lower(s_name || ' & Co. #' || s_suppkey), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
      regexp_replace(trim(regexp_replace(s_name || ' & Co. #' || s_suppkey, '[^\\w\\s-]', '', 'g')), '\\s+', '_', 'g')[:100] AS file_name FROM supplier
    """
)
def names_for_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("s_name", F.lit(" & Co. #"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.slug(name).alias("slug"), T.file_name(name).alias("file_name"))


@query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[0-9]+[.)]\\s')) AS numeric, count(*) FILTER (regexp_matches(line, '^[a-z][.)]\\s')) AS letter,
      count(*) FILTER (regexp_matches(line, '^[A-Z][.)]\\s')) AS upper_letter, count(*) FILTER (regexp_matches(line, '^[-*•]+')) AS unordered
    FROM l GROUP BY 1
    """
)
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that begin with list markers."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("kind", T.marker(F.col("line")))
    return lines.groupBy("doc_id").agg(*(F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).alias(k) for k in ("numeric", "letter", "upper_letter", "unordered")))


@query(
    """
    WITH RECURSIVE h AS (SELECT l_orderkey, l_linenumber, 1 + (l_partkey + l_linenumber) % 6 AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, level, i, least(level, 2) AS repaired FROM h WHERE i = 1
      UNION ALL SELECT h.l_orderkey, h.l_linenumber, h.level, h.i, least(h.level, r.repaired + 1) FROM r JOIN h ON h.l_orderkey = r.l_orderkey AND h.i = r.i + 1)
    SELECT l_orderkey, i::INTEGER AS place, level::INTEGER AS level, repaired::INTEGER AS repaired FROM r
    """
)
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings made of order lines, repaired by a running minimum."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, (1 + (F.col("l_partkey") + F.col("l_linenumber")) % 6).cast("int").alias("level"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return D.repaired_levels(rows.withColumn("place", place), ["l_orderkey"], ["place"]).select("l_orderkey", "place", "level", "repaired")


@query(
    """
    WITH s AS (SELECT p_brand, round_even(p_size / 3.0 * 2, 0) / 2 AS size, sum(length(p_name)) AS w FROM part GROUP BY ALL),
    b AS (SELECT p_brand, arg_max(size, (w, -size)) AS body FROM s GROUP BY 1),
    r AS (SELECT p_brand, body, size, dense_rank() OVER (PARTITION BY p_brand ORDER BY size DESC) + 1 AS level FROM s JOIN b USING (p_brand) WHERE size > body)
    SELECT p_brand, body AS body_size, size, level::INTEGER AS level FROM r WHERE level <= 6
    """
)
def heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body size and heading levels by how much text each size has."""
    items = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 3.0).alias("font_size"), F.col("p_name").alias("text"))
    return D.heading_map(items, "p_brand")


@query(
    """
    WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 = 0 AS s, sum((o_orderkey % 5 = 0)::INT) OVER (PARTITION BY o_custkey) AS n,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k,
      sum((o_orderkey % 5 = 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders)
    SELECT o_custkey, o_orderkey, (CASE WHEN n BETWEEN 2 AND 30 THEN run ELSE k // 20 + 1 END)::INTEGER AS chapter FROM p
    """
)
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("page_num"), (F.col("o_orderkey") % 5 == 0).alias("starts"))
    return D.chapters(rows, "o_custkey").withColumnRenamed("page_num", "o_orderkey")


@query()
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of whole lines with at most 500 words."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(D.word_chunks(F.col("text"), 500)).alias("chunk", "text"))
    return chunks.select("doc_id", "chunk", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("words"))


@query(
    """
    WITH i AS (SELECT o_orderkey, l_linenumber, (l_linenumber * 3) % 4 AS pos FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
    q AS (SELECT *, lag(pos) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, pos) AS before FROM i)
    SELECT count(DISTINCT o_orderkey) FILTER (l_linenumber IS NULL) AS empty_modules, count(DISTINCT o_orderkey) FILTER (pos < before) AS unordered_modules FROM q
    """
)
def module_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as modules and their lines as items: empty ones, and ones out of order."""
    lines = table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("n"), ((F.col("l_linenumber") * 3) % 4).cast("int").alias("position"), F.lit("x").alias("title"))
    gathered = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    items = F.transform(F.coalesce("items", F.array().cast("array<struct<n:int,position:int,title:string>>")), lambda i: F.struct(i["title"].alias("title"), i["position"].alias("position")))
    modules = orders.join(gathered, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("name"), items.alias("items"))
    found = D.structure_issues(modules)
    return found.agg(F.count_if(F.col("message").contains("has no items")).alias("empty_modules"), F.count_if(F.col("category") == "navigation").alias("unordered_modules"))


@query(
    """
    SELECT page_id, url, regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.([^./]*)$', 1) AS tail, regexp_extract(url, '^([a-z]+):', 1) IN ('http', 'https', 'ftp', 'mailto') AS is_external FROM pages
    """
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", D.is_external(F.col("url")).alias("is_external"))
    return rows.select("page_id", "url", F.regexp_extract(F.lower(F.regexp_replace("url", r"[?#].*$", "")), r"\.([^./]*)$", 1).alias("tail"), "is_external")


@query(
    """
    SELECT user_id % 20 AS course_id, date_trunc('day', ts) AS start, count(*) AS reports,
      round_even(100 * exp(-((count(*) FILTER (event_type = 'error') + 0.25 * count(*) FILTER (event_type <> 'error')) / count(*)) / 4.0), 1) AS score
    FROM events GROUP BY 1, 2
    """
)
def score_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per course and day; the same expression runs over streams."""
    from lumenpage.streaming.monitor import score_trend as trend

    events = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    rows = events.select((F.col("user_id") % 20).alias("course_id"), F.col("ts").cast("timestamp").alias("analyzed_at"), error.cast("long").alias("errors"), (~error).cast("long").alias("warnings"), F.lit(1).cast("long").alias("pages"))
    return trend(rows).select("course_id", F.col("start").cast("timestamp_ntz").alias("start"), "reports", "score")


@query(
    f"""
    WITH c AS (SELECT {HOST} AS course_id, count(*) AS pages, sum(len(regexp_extract_all(html, '<h1[ >]'))) AS n FROM pages GROUP BY 1)
    SELECT course_id, round_even(avg(CASE WHEN n = 0 THEN 1.0 ELSE 47.0 / 48 END) * 100, 1) AS conformance_pct, CASE WHEN max(n) = 0 THEN 'Supports' ELSE 'Partially Supports' END AS overall_status FROM c GROUP BY 1
    """
)
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pages(spark, sf_dir)
    rollup = report.criteria_rollup(own, scanned(own, only={"HDG001"}))
    return report.conformance_summary(rollup).select("course_id", "conformance_pct", "overall_status")


@query(
    "SELECT severity, category, count(*) AS rules FROM (VALUES "
    + ", ".join(f"('{r.severity}', '{r.category}')" for r in RULES)
    + ") t(severity, category) GROUP BY CUBE (severity, category)"
)
def rule_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by severity and category, with subtotals."""
    return dims.rules(spark).cube("severity", "category").agg(F.count("*").alias("rules"))
