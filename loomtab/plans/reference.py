"""Queries of the table, crawl and graph operators over the test tables, each with its SQL.

Tables are rendered from relational rows, so that the SQL is a plain relational query: customers in blocks of forty make
one table each (``CUST``), suppliers in blocks of twenty make pages that are rendered to HTML and parsed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.config import COL, INFO, PROPERTY, ROW, TITLE, Config
from loomtab.functions import celltypes as C
from loomtab.functions import names as N
from loomtab.functions.text import ustrip
from loomtab.functions.urls import decode_percent, last_segment
from loomtab.functions.words import word_score
from loomtab.operators import crawl, extract, graph, html, tables
from loomtab.sources import sinks
from loomtab.session import checkpoint_dir, table
from loomtab.streaming import jobs

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- rendered cells --------------------------------------------------------------------------------------------------
HEADERS = ["姓名", "关系", "编号", "备注"]


def _t(s: str) -> str:
    return s.strip()


def cust_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.floor(k / 40).cast("int").alias("table_id"), (k % 40 + 1).cast("int").alias("row"), F.col("c_name").alias("v0"),
        F.substring("c_mktsegment", 1, 4).substr(F.lit(1), (F.lit(2) + k % 3).cast("int")).alias("v1"), F.col("c_custkey").cast("string").alias("v2"),
        F.when(F.col("c_acctbal") < 0, "——").when(k % 7 == 0, "").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("v3"),
    )


_ROWS = """
WITH r AS (SELECT (c_custkey // 40)::INT AS table_id, (c_custkey % 40 + 1)::INT AS row, c_name AS v0,
  substr(substr(c_mktsegment, 1, 4), 1, (2 + c_custkey % 3)::INT) AS v1, c_custkey::VARCHAR AS v2,
  CASE WHEN c_acctbal < 0 THEN '——' WHEN c_custkey % 7 = 0 THEN '' ELSE 'n' || c_nationkey::VARCHAR END AS v3 FROM customer)"""
_CELLS = (
    _ROWS
    + """, cells AS (
  SELECT table_id, row, 0 AS col, v0 AS content, 'td' AS tag FROM r UNION ALL SELECT table_id, row, 1, v1, 'td' FROM r
  UNION ALL SELECT table_id, row, 2, v2, 'td' FROM r UNION ALL SELECT table_id, row, 3, v3, 'td' FROM r
  UNION ALL SELECT table_id, 0, col, content, 'th' FROM (SELECT DISTINCT table_id FROM r) CROSS JOIN (VALUES (0, '姓名'), (1, '关系'), (2, '编号'), (3, '备注')) h(col, content))"""
)


def cust_cells(spark: SparkSession, d: str, header_tag: str = "th") -> DataFrame:
    r = cust_rows(spark, d)
    body = r.selectExpr("table_id", "row", "stack(4, 0, v0, 1, v1, 2, v2, 3, v3) as (col, content)").withColumn("tag", F.lit("td"))
    heads = ", ".join(f"{i}, '{h}'" for i, h in enumerate(HEADERS))
    head = r.select("table_id").distinct().selectExpr("table_id", "0 as row", f"stack(4, {heads}) as (col, content)").withColumn("tag", F.lit(header_tag))
    return body.unionByName(head)


def plain_cells(spark: SparkSession, d: str) -> DataFrame:
    """Only data cells, for the features."""
    return cust_cells(spark, d).where("row > 0").withColumn("row", F.col("row") - 1)


_PLAIN = _CELLS + ", plain AS (SELECT table_id, row - 1 AS row, col, content, 'td' AS tag FROM cells WHERE row > 0)"


def supplier_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for twenty suppliers: a captioned table (with a spanned last column), an infobox and a list table."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    s = s.withColumn("page_id", F.floor(k / 20).cast("long")).withColumn("i", (k % 20).cast("int"))
    link = F.concat(F.lit('<a href="/item/'), "s_suppkey", F.lit('">'), "s_name", F.lit("</a>[1]"))
    cells = [link, F.substring("n_name", 1, 6), F.col("s_suppkey").cast("string")]
    tr = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.when(F.col("i") % 2 == 0, F.concat(F.lit('<td rowspan="2">'), "n_name", F.lit("</td>"))).otherwise(F.lit("")), F.lit("</tr>"))
    li = F.concat(F.lit("<li><span>▪</span><span>"), "s_name", F.lit("</span><span>"), "n_name", F.lit("</span></li>"))

    def joined(c: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("t")))), lambda x: x["t"]), "")

    g = s.groupBy("page_id").agg(joined(tr).alias("trs"), joined(li).alias("lis"), F.min_by("s_name", "i").alias("first"), F.min_by("n_name", "i").alias("first_nation"))
    page = F.concat(
        F.lit('<html><head><script>var a="<table></table>";</script></head><body><dl class="basic-info cmn-clearfix"><dt>中文名</dt><dd>'), "first", F.lit("</dd><dt>国籍</dt><dd>"), "first_nation",
        F.lit('<br/>x[2]</dd></dl><div class="t-title">兄弟'), F.col("page_id").cast("string"),
        F.lit("</div><table><tr><th>姓名</th><th>关系</th><th>编号</th><th>国家</th></tr>"), "trs", F.lit('</table><p><b>无</b></p><table><tr><td>1</td></tr></table><div class="normal title-td">名单</div><ul>'), "lis", F.lit("</ul></body></html>"),
    )
    return g.select("page_id", F.concat(F.lit("https://baike.example.com/item/P"), F.col("page_id").cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("url"), page.alias("html"))


_SUP = """
WITH s AS (SELECT (s_suppkey // 20)::BIGINT AS page_id, (s_suppkey % 20)::INT AS i, s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT page_id, count(*) AS n FROM s GROUP BY page_id)"""
_SUPCELLS = (
    _SUP
    + """, cells AS (
  SELECT page_id, i + 1 AS row, 0 AS col, s_name AS content FROM s UNION ALL SELECT page_id, i + 1, 1, substr(n_name, 1, 6) FROM s
  UNION ALL SELECT page_id, i + 1, 2, s_suppkey::VARCHAR FROM s
  UNION ALL SELECT a.page_id, a.i + 1, 3, b.n_name FROM s a JOIN s b ON a.page_id = b.page_id AND b.i = a.i - a.i % 2
  UNION ALL SELECT page_id, 0, col, h FROM n CROSS JOIN (VALUES (0, '姓名'), (1, '关系'), (2, '编号'), (3, '国家')) v(col, h))"""
)


def _parsed(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    p = html.parse_tables(supplier_pages(spark, d))
    return p.where(F.col("kind") == kind) if kind else p


# ---- sources, sinks --------------------------------------------------------------------------------------------------
@query("SELECT p.id, length(p.html) AS n FROM person_url_html p WHERE p.url IN (SELECT url FROM documents)")
def a2_fetch_snapshot(spark, d):
    return crawl.fetch(table(spark, d, "documents"), table(spark, d, "person_url_html")).select("id", F.length("html").alias("n"))


@query("SELECT id, url FROM pending_url ORDER BY id LIMIT 100")
def a3_queue_head(spark, d):
    return table(spark, d, "pending_url").select("id", "url").orderBy("id").limit(100)


_UNESC = "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query(f"SELECT id, md5({_UNESC.format('html')}) AS h FROM person_url_html WHERE html IS NOT NULL")
def a4_scan_unescape(spark, d):
    return table(spark, d, "person_url_html").where("html is not null").select("id", F.md5(N.unescape_html(F.col("html"))).alias("h"))


@query("SELECT id, url FROM useless_url WHERE (SELECT count(*) FROM pending_url) <= 1000000 UNION ALL SELECT id, url FROM pending_url")
def b1_capped_append(spark, d):
    from loomtab.sources.queues import capped_append

    return capped_append(table(spark, d, "pending_url").select("id", "url"), table(spark, d, "useless_url").select("id", "url"))


@query("SELECT id, url FROM pending_url WHERE id NOT IN (SELECT id FROM pending_url ORDER BY id LIMIT 100)")
def b4_consume_left(spark, d):
    q = table(spark, d, "pending_url").select("id", "url")
    return q.join(a3_queue_head(spark, d).select("id"), "id", "left_anti")


@query("SELECT p_partkey, '<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>' || p_brand || '</title></head><body>' || '<p>' || p_name || '</p>' || '</body></html>' AS doc FROM part")
def b10_tag_document(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", html.tag_document(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")), F.col("p_brand")).alias("doc"))


_MARKUP = r"(?i)<\s*(?:!doctype|/?[a-z][a-z0-9]*[\s/>])"
#: Stored pages, unescaped until markup appears; the tables hold pages escaped twice at most.
_PAGES = f"""(SELECT id, url, CASE WHEN regexp_matches(h0, '{_MARKUP}') THEN h0 WHEN regexp_matches(h1, '{_MARKUP}') THEN h1 WHEN regexp_matches(h2, '{_MARKUP}') THEN h2 ELSE {_UNESC.format('h2')} END AS html
 FROM (SELECT *, {_UNESC.format('h1')} AS h2 FROM (SELECT id, url, html AS h0, {_UNESC.format('html')} AS h1 FROM person_url_html WHERE html IS NOT NULL)))"""


# ---- html ------------------------------------------------------------------------------------------------------------
@query("SELECT id, md5(replace(replace(replace(html, chr(13), ''), chr(9), ''), chr(10), '')) AS h FROM person_url_html WHERE html IS NOT NULL")
def h1_strip_ws(spark, d):
    return table(spark, d, "person_url_html").where("html is not null").select("id", F.md5(html.strip_breaks(F.col("html"))).alias("h"))


_BLOCKS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<article\\b[^>]*>.*?</article\\s*>', '', 'g'), '(?is)<code\\b[^>]*>.*?</code\\s*>', '', 'g')"


@query(f"SELECT id, md5({_BLOCKS}) AS h FROM {_PAGES}")
def h2_drop_blocks(spark, d):
    return table(spark, d, "person_url_html").where("html is not null").select("id", F.md5(html.drop_blocks(N.page_markup(F.col("html")))).alias("h"))


@query(_SUP + ", k AS (SELECT * FROM (VALUES (0, 'infobox'), (1, 'list'), (2, 'table')) v(table_id, kind)) SELECT page_id, table_id, kind FROM n CROSS JOIN k")
def h3_locate_tables(spark, d):
    return _parsed(spark, d).select("page_id", "table_id", "kind").distinct()


@query(f"SELECT id AS page_id, len(regexp_extract_all({_BLOCKS.replace('article', 'code')}, '(?i)<table[\\s>]')) AS tables FROM {_PAGES} WHERE regexp_matches({_BLOCKS.replace('article', 'code')}, '(?i)<table[\\s>]')")
def h3_stored_tables(spark, d):
    """Tables of the stored pages, whatever their escaping at rest."""
    return html.table_measures(table(spark, d, "person_url_html"), id_col="id").groupBy("page_id").agg(F.count(F.lit(1)).alias("tables"))


@query(_SUP + """, f AS (SELECT * FROM s WHERE i = 0) SELECT page_id, row, col, content, preset FROM (
 SELECT page_id, 0 AS row, 0 AS col, '中文名' AS content FROM f UNION ALL SELECT page_id, 0, 1, s_name FROM f
 UNION ALL SELECT page_id, 1, 0, '国籍' FROM f UNION ALL SELECT page_id, 1, 1, n_name || '/x' FROM f) CROSS JOIN (SELECT '个人信息表' AS preset)""")
def h4_infobox(spark, d):
    return _parsed(spark, d, "infobox").select("page_id", "row", "col", "content", "preset")


@query(_SUP + " SELECT page_id, i AS row, 0 AS col, s_name AS content, '名单' AS caption FROM s UNION ALL SELECT page_id, i, 1, n_name, '名单' FROM s")
def h5_list_table(spark, d):
    return _parsed(spark, d, "list").select("page_id", "row", "col", "content", "caption")


@query(_SUP + " SELECT page_id, 0 AS table_no, true AS shape_ok FROM n UNION ALL SELECT page_id, 1, false FROM n")
def h7_min_shape(spark, d):
    return html.table_measures(supplier_pages(spark, d)).select("page_id", "table_no", "shape_ok")


@query(_SUP + " SELECT page_id, 0 AS table_no, n::INT AS links, 0 AS images, true AS density_ok FROM n UNION ALL SELECT page_id, 1, 0, 0, true FROM n")
def h8_density_rule(spark, d):
    return html.table_measures(supplier_pages(spark, d)).select("page_id", "table_no", "links", "images", "density_ok")


@query(_SUP + " SELECT page_id, 0 AS table_no, true AS words_ok FROM n UNION ALL SELECT page_id, 1, false FROM n")
def h9_wording_rule(spark, d):
    return html.table_measures(supplier_pages(spark, d)).select("page_id", "table_no", "words_ok")


@query(_SUP + " SELECT page_id, 0 AS table_no, true AS ok FROM n UNION ALL SELECT page_id, 1, false FROM n")
def h10_heuristics(spark, d):
    m = html.table_measures(supplier_pages(spark, d))
    return m.select("page_id", "table_no", (F.col("shape_ok") & F.col("density_ok") & F.col("words_ok")).alias("ok"))


@query(_SUP + " SELECT page_id, '兄弟' || page_id::VARCHAR AS caption FROM n")
def h11_caption(spark, d):
    return _parsed(spark, d, "table").select("page_id", "caption").distinct()


@query(_SUPCELLS + " SELECT page_id, row, col, content FROM cells")
def h12_cells(spark, d):
    return _parsed(spark, d, "table").select("page_id", "row", "col", "content")


@query(_SUP + " SELECT page_id, i + 1 AS row, s_name AS text, 'https://baike.example.com/item/' || s_suppkey::VARCHAR AS url FROM s")
def h13_cell_links(spark, d):
    return _parsed(spark, d, "table").select("page_id", "row", F.explode("links").alias("text", "url"))


_SEG = "split({u}, '/')"
_NAME = "url_decode(replace(CASE WHEN regexp_matches(list_extract(string_split({u}, '/'), -1), '^[0-9]+$') THEN list_extract(string_split({u}, '/'), -2) ELSE list_extract(string_split({u}, '/'), -1) END, '+', '%2B'))"


@query(f"SELECT id, {_NAME.format(u='url')} AS name FROM person_url_html WHERE url IS NOT NULL")
def h14_page_name(spark, d):
    return table(spark, d, "person_url_html").where("url is not null").select("id", html.name_of_page(F.col("url")).alias("name"))


# ---- links and crawl -------------------------------------------------------------------------------------------------
_HREFS = f"""SELECT DISTINCT id AS page_id, trim(regexp_replace(h, '^["'']|["'']$', '', 'g')) AS href FROM (SELECT id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)) AS h FROM {_PAGES})"""
_SCORED = f"""SELECT page_id, href, 'https://baike.example.com' || href AS url,
 CASE WHEN starts_with(href, '/item/') AND regexp_matches({_NAME.format(u="regexp_replace(href, '^/item/', '')")}, '^([\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}|[A-Z][a-z]+ [A-Z][a-z]+)$') THEN 1.0 ELSE 0.0 END AS score FROM ({_HREFS})"""


def _links(spark, d):
    return crawl.links(table(spark, d, "person_url_html"), "id")


@query(_HREFS)
def c1_links(spark, d):
    return _links(spark, d)


@query(f"SELECT page_id, href, 'https://baike.example.com' || href AS url FROM ({_HREFS})")
def c2_absolutise(spark, d):
    return crawl.absolute(_links(spark, d))


@query(f"SELECT page_id, href, score::DOUBLE AS score FROM ({_SCORED})")
def c3_relevance(spark, d):
    return _links(spark, d).withColumn("score", crawl.relevance(F.col("href")))


@query(f"SELECT page_id, href, score >= 0.8 AS useful FROM ({_SCORED})")
def c4_route(spark, d):
    return crawl.route(_links(spark, d)).select("page_id", "href", "useful")


@query("SELECT id, url FROM useless_url WHERE starts_with(url, 'https://baike.example.com/item/') AND NOT contains(list_extract(string_split(url, '/'), -1), '.')")
def c5_possible(spark, d):
    return crawl.possible(table(spark, d, "useless_url")).select("id", "url")


@query("SELECT DISTINCT url FROM pending_url WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM useless_url WHERE url IS NOT NULL)")
def c6_unseen(spark, d):
    return crawl.unseen(table(spark, d, "pending_url").where("url is not null").select("url"), table(spark, d, "useless_url").where("url is not null"))


def _step_sql(frontier: str) -> str:
    return f"""SELECT s.url, max(score) >= 0.8 AS useful FROM ({_SCORED}) s JOIN person_url_html p ON p.id = page_id
 WHERE p.url IN (SELECT url FROM {frontier} WHERE url IS NOT NULL) AND s.url NOT IN (SELECT url FROM person_url_html WHERE url IS NOT NULL) GROUP BY 1"""


def _step(spark, d, frontier: DataFrame) -> DataFrame:
    pages = table(spark, d, "person_url_html").withColumnRenamed("id", "page_id")
    return crawl.step(frontier, pages, pages.where("url is not null").select("url").distinct())


@query(_step_sql("documents"))
def c7_seed_step(spark, d):
    return _step(spark, d, table(spark, d, "documents").where("url is not null"))


_EDGES = "SELECT DISTINCT c0, c2 FROM relation_triad WHERE c0 IS NOT NULL AND c2 IS NOT NULL"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT c0 AS node FROM relation_triad WHERE row_id = (SELECT min(row_id) FROM relation_triad WHERE c0 IS NOT NULL)),
 b(node, depth) AS (SELECT node, 0 FROM s UNION SELECT e.c2, b.depth + 1 FROM b JOIN e ON b.node = e.c0 WHERE b.depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def c8_bfs_reach(spark, d):
    t = table(spark, d, "relation_triad").where("c0 is not null")
    seeds = t.agg(F.min_by("c0", "row_id").alias("node"))
    e = t.where("c2 is not null").select(F.col("c0").alias("src"), F.col("c2").alias("dst")).distinct()
    return crawl.reach(seeds, e, 3)


@query("SELECT s.url, false AS stored FROM (" + _step_sql("documents") + ") s WHERE NOT s.useful")
def c9_useless_step(spark, d):
    """The step over the other queue: links are taken, pages aren't stored."""
    return _step(spark, d, table(spark, d, "documents").where("url is not null")).where("not useful").select("url", F.lit(False).alias("stored"))


# ---- cell types and features -----------------------------------------------------------------------------------------
_SAMPLES = ["", "——", "0", "00", "007", "12", "5岁", "-5", "0.5", "50%", "中文", "ABC", "abc", "aBc", "第1名", "a b", "_", "http://x.y/z", "１２", " 3 "]
_TRIMMED = "regexp_replace(coalesce({c}, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _type_sql(c: str) -> str:
    s = _TRIMMED.format(c=c)
    han = "\\x{4e00}-\\x{9fa5}"
    return f"""CASE WHEN regexp_matches({s}, '^(?:https?|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|]') THEN '超链接'
 WHEN regexp_matches({s}, '^[^\\p{{L}}\\p{{N}}\\p{{M}}_]*$') THEN '标点类型' WHEN NOT regexp_matches({s}, '^[{han}A-Za-z0-9]+$') THEN '其他类型'
 WHEN regexp_matches({s}, '^[0-9]+[{han}]?$') THEN CASE WHEN regexp_matches({s}, '^0+$') THEN '<=0' WHEN regexp_matches({s}, '^[1-9][0-9]*$') THEN '>=1' ELSE '数字类型' END
 WHEN regexp_matches({s}, '^[{han}]+$') THEN '中文' WHEN regexp_matches({s}, '^[A-Z]+$') THEN '大写' WHEN regexp_matches({s}, '^[a-z]+$') THEN '小写'
 WHEN regexp_matches({s}, '^[A-Za-z]+$') THEN '大小写混合' ELSE '字符类型' END"""


_VALUES = "SELECT row_id AS k, value AS v FROM entity_triad UNION ALL SELECT -i, v FROM (VALUES " + ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(_SAMPLES)) + ") x(i, v)"


@query(f"SELECT k, {_type_sql('v')} AS cell_type FROM ({_VALUES})")
def f1_cell_type(spark, d):
    values = table(spark, d, "entity_triad").select(F.col("row_id").alias("k"), F.col("value").alias("v"))
    extra = spark.createDataFrame([(-i - 1, s) for i, s in enumerate(_SAMPLES)], "k long, v string")
    return values.unionByName(extra).select("k", C.cell_type(F.col("v")).alias("cell_type"))


@query(_CELLS + f" SELECT table_id, row, col, {_type_sql('content')} AS cell_type FROM cells")
def f2_typed_cells(spark, d):
    return tables.typed(cust_cells(spark, d)).select("table_id", "row", "col", "cell_type")


_FEATURE = """, lc AS (SELECT table_id, avg(s) AS c FROM (SELECT table_id, stddev_pop(length(content)) AS s FROM {t} GROUP BY table_id, col) GROUP BY table_id),
lr AS (SELECT table_id, avg(s) AS r FROM (SELECT table_id, stddev_pop(length(content)) AS s FROM {t} GROUP BY table_id, row) GROUP BY table_id),
lf AS (SELECT table_id, CASE WHEN r + c = 0 THEN 0 ELSE r / (r + c) END AS row_length, CASE WHEN r + c = 0 THEN 0 ELSE c / (r + c) END AS col_length FROM lc JOIN lr USING (table_id))"""


@query(_PLAIN + _FEATURE.format(t="plain") + " SELECT table_id, round(row_length, 6) AS row_length, round(col_length, 6) AS col_length FROM lf")
def f4_length_feature(spark, d):
    return tables.length_feature(plain_cells(spark, d)).select("table_id", F.round("row_length", 6).alias("row_length"), F.round("col_length", 6).alias("col_length"))


def _type_table_sql() -> str:
    return "(VALUES " + ", ".join(f"('{a}', {C.depth(a)})" for a in C.PARENT) + ") t(cell_type, depth)"


_PARENTS = "(VALUES " + ", ".join(f"('{a}', '{p}')" for a, p in C.PARENT.items() if p) + ") p(child, parent)"
_DIST = f"""up AS (WITH RECURSIVE u(t, a, n) AS (SELECT cell_type, cell_type, 0 FROM {_type_table_sql()} UNION ALL SELECT u.t, p.parent, u.n + 1 FROM u JOIN {_PARENTS} ON u.a = p.child) SELECT * FROM u),
dist AS (SELECT x.t AS a, y.t AS b, min(x.n + y.n) AS dist FROM up x JOIN up y ON x.a = y.a GROUP BY 1, 2)"""


@query(f"SELECT cell_type, depth FROM {_type_table_sql()}")
def f6_type_depth(spark, d):
    return spark.createDataFrame([(t,) for t in C.PARENT], "cell_type string").select("cell_type", C.type_depth(F.col("cell_type")).alias("depth"))


@query(f"WITH {_DIST} SELECT a, b, dist FROM dist")
def f7_type_distance(spark, d):
    t = spark.createDataFrame([(x, y) for x in C.PARENT for y in C.PARENT], "a string, b string")
    return t.select("a", "b", C.type_distance(F.col("a"), F.col("b")).alias("dist"))




def _typed_sql(t: str) -> str:
    return f", {_DIST}, ty AS (SELECT table_id, row, col, tag, {_type_sql('content')} AS ct FROM {t})"




@query(_CELLS + _typed_sql("cells") + " SELECT x.table_id, round(avg(dist), 6) AS distance FROM ty x JOIN ty y ON x.table_id = y.table_id AND x.col = y.col JOIN dist ON a = x.ct AND b = y.ct WHERE x.row = 1 AND y.row = 2 GROUP BY 1")
def f8_vector_distance(spark, d):
    return tables.vector_distance(cust_cells(spark, d), 1, 2).select("table_id", F.round("distance", 6).alias("distance"))


_TFEATURE = """, ed AS (SELECT table_id, max(row) AS lr, max(col) AS lc FROM ty GROUP BY table_id),
tc AS (SELECT table_id, avg(m) AS c FROM (SELECT x.table_id, x.row, avg(dist) AS m FROM ty x JOIN ed USING (table_id) JOIN ty y ON y.table_id = x.table_id AND y.row = lr AND y.col = x.col JOIN dist ON a = x.ct AND b = y.ct WHERE x.row < lr GROUP BY 1, 2) GROUP BY 1),
tr AS (SELECT table_id, avg(m) AS r FROM (SELECT x.table_id, x.col, avg(dist) AS m FROM ty x JOIN ed USING (table_id) JOIN ty y ON y.table_id = x.table_id AND y.col = lc AND y.row = x.row JOIN dist ON a = x.ct AND b = y.ct WHERE x.col < lc GROUP BY 1, 2) GROUP BY 1),
tf AS (SELECT table_id, CASE WHEN coalesce(r, 0) + coalesce(c, 0) = 0 THEN 0 ELSE coalesce(r, 0) / (coalesce(r, 0) + coalesce(c, 0)) END AS row_type, CASE WHEN coalesce(r, 0) + coalesce(c, 0) = 0 THEN 0 ELSE coalesce(c, 0) / (coalesce(r, 0) + coalesce(c, 0)) END AS col_type
 FROM ed LEFT JOIN tc USING (table_id) LEFT JOIN tr USING (table_id))"""


@query(_PLAIN + _typed_sql("plain") + _TFEATURE + " SELECT table_id, round(row_type, 6) AS row_type, round(col_type, 6) AS col_type FROM tf")
def f9_type_feature(spark, d):
    return tables.type_feature(plain_cells(spark, d)).select("table_id", F.round("row_type", 6).alias("row_type"), F.round("col_type", 6).alias("col_type"))


_SCORE = """(len(regexp_extract_all({c}, '\\p{{Han}}+')) + 2 * len(regexp_extract_all({c}, '[A-Za-z]+')) + 3 * len(regexp_extract_all({c}, '[0-9]+')) + 4 * len(regexp_extract_all({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s]+')))"""


@query(f"SELECT row_id, {_SCORE.format(c='value')} AS score FROM entity_triad WHERE value IS NOT NULL")
def f3_word_score(spark, d):
    return table(spark, d, "entity_triad").where("value is not null").select("row_id", word_score(F.col("value")).cast("long").alias("score"))


@query(_PLAIN + _FEATURE.format(t="plain").replace("length(content)", _SCORE.format(c="content")) + " SELECT table_id, round(row_length, 6) AS row_word, round(col_length, 6) AS col_word FROM lf")
def f5_word_feature(spark, d):
    return tables.word_feature(plain_cells(spark, d)).select("table_id", F.round("row_word", 6).alias("row_word"), F.round("col_word", 6).alias("col_word"))


# ---- table algebra ---------------------------------------------------------------------------------------------------
@query(_ROWS + " SELECT table_id, row, 0 AS col, v0 AS content FROM r UNION ALL SELECT table_id, row, 1, v0 FROM r UNION ALL SELECT a.table_id, a.row, 2, b.v1 FROM r a JOIN r b ON a.table_id = b.table_id AND b.row = a.row - (a.row - 1) % 3")
def t1_expand_spans(spark, d):
    r = cust_rows(spark, d)
    a = r.selectExpr("table_id", "row", "0 as col", "1 as rowspan", "2 as colspan", "v0 as content")
    b = r.where("(row - 1) % 3 = 0").selectExpr("table_id", "row", "2 as col", "3 as rowspan", "1 as colspan", "v1 as content")
    return tables.expand_spans(a.unionByName(b)).select("table_id", "row", "col", "content")


@query(_SUPCELLS + " SELECT page_id, row, col, (row = 0 OR col < 3 OR (row - 1) % 2 = 0) AS anchor FROM cells")
def t2_positions(spark, d):
    return _parsed(spark, d, "table").select("page_id", "row", "col", "anchor")


_HOLED = _CELLS + ", holed AS (SELECT * FROM cells UNION ALL SELECT DISTINCT table_id, 2, 4, 'x', 'td' FROM cells WHERE table_id % 3 = 0)"


def _holed(spark, d):
    """All tables; each third one has a cell too many in its second row."""
    c = cust_cells(spark, d)
    more = c.select("table_id").distinct().where("table_id % 3 = 0").selectExpr("table_id", "2 as row", "4 as col", "'x' as content", "'td' as tag")
    return c.unionByName(more)


@query(_HOLED + " SELECT table_id, min(n) = max(n) AS is_correct FROM (SELECT table_id, row, count(*) AS n FROM holed GROUP BY 1, 2) GROUP BY 1")
def t3_is_correct(spark, d):
    return tables.shapes(_holed(spark, d)).select("table_id", "is_correct")


@query(_CELLS + ", more AS (SELECT * FROM cells UNION ALL SELECT table_id + 1000000, row, col, content, tag FROM cells WHERE row = 0) SELECT table_id, count(DISTINCT row) >= 2 AND max(col) >= 1 AS is_normal FROM more GROUP BY 1")
def t4_is_normal(spark, d):
    """All tables, and each one's header as a table of its own."""
    c = cust_cells(spark, d)
    alone = c.where("row = 0").withColumn("table_id", (F.col("table_id") + 1_000_000).cast("int"))
    return tables.shapes(c.unionByName(alone)).select("table_id", "is_normal")


@query(_CELLS + " SELECT table_id, col AS row, row AS col, content FROM cells")
def t5_flip(spark, d):
    return tables.flip(cust_cells(spark, d)).select("table_id", "row", "col", "content")


@query(_CELLS + " SELECT table_id, CASE WHEN row > 2 THEN row - 1 ELSE row END AS row, col, content FROM cells WHERE row <> 2")
def t6_drop_row(spark, d):
    return tables.drop_row(cust_cells(spark, d), 2).select("table_id", "row", "col", "content")


@query(_CELLS + " SELECT table_id, row, CASE WHEN col > 1 THEN col - 1 ELSE col END AS col, content FROM cells WHERE col <> 1")
def t7_drop_col(spark, d):
    return tables.drop_col(cust_cells(spark, d), 1).select("table_id", "row", "col", "content")


@query(_CELLS + " SELECT table_id, col, content FROM cells WHERE row = 3")
def t8_row_slice(spark, d):
    return tables.row_at(cust_cells(spark, d), 3).select("table_id", "col", "content")


@query(_CELLS + " SELECT table_id, row, content FROM cells WHERE col = 2")
def t9_col_slice(spark, d):
    return tables.col_at(cust_cells(spark, d), 2).select("table_id", "row", "content")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_linenumber::VARCHAR, '') AS content FROM lineitem")
def t10_stringify(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("content"))
    return tables.stringify(t)


@query(_PLAIN + _FEATURE.format(t="plain") + _typed_sql("plain") + _TFEATURE + """ SELECT table_id, CASE WHEN round(0.5 * row_length + 0.5 * row_type, 12) > round(0.5 * col_length + 0.5 * col_type, 12) THEN 'COL' ELSE 'ROW' END AS direction FROM lf JOIN tf USING (table_id)
 UNION ALL SELECT DISTINCT -1 - table_id, 'ROW' FROM cells UNION ALL SELECT DISTINCT -1000000 - table_id, 'COL' FROM cells""")
def t11_direction(spark, d):
    whole = cust_cells(spark, d)
    a = plain_cells(spark, d)
    b = whole.withColumn("table_id", -1 - F.col("table_id"))
    c = tables.flip(whole).withColumn("table_id", -1000000 - F.col("table_id"))
    return tables.direction(a.unionByName(b).unionByName(c))


@query(_CELLS + " SELECT DISTINCT table_id, 1::BIGINT AS lines FROM cells")
def t12_header_tags(spark, d):
    return tables.header_lines(cust_cells(spark, d), "tag")


@query(_CELLS + f""", ok AS (SELECT table_id, row, min(({_type_sql('content')} IN ('中文', '英文', '大写', '小写', '大小写混合', '字符类型', '超链接', '其他类型', '标点类型'))::INT) AS ok FROM cells GROUP BY 1, 2)
 SELECT table_id, coalesce(min(CASE WHEN ok = 0 THEN row END), 0)::BIGINT AS lines FROM ok GROUP BY 1""")
def t13_header_types(spark, d):
    return tables.header_lines(cust_cells(spark, d), "type")


@query(_CELLS + " SELECT DISTINCT table_id, 1::BIGINT AS lines FROM cells")
def t14_header_count(spark, d):
    return tables.header_count(cust_cells(spark, d), Config(strict_header=True))


@query(_CELLS + " SELECT table_id, col, content AS header FROM cells WHERE row = 0")
def t15_headers(spark, d):
    return tables.headers(cust_cells(spark, d))


@query(_SUP + " SELECT page_id, s_name AS text, 'https://baike.example.com/item/' || min(s_suppkey)::VARCHAR AS url FROM s GROUP BY 1, 2")
def t16_href_map(spark, d):
    return tables.href_map(_parsed(spark, d, "table"), ["page_id"]).select("page_id", "text", "url")


_SERIAL = _CELLS + """, sc AS (SELECT table_id, row, col, CASE WHEN row = 0 AND col = 2 THEN '序号' WHEN table_id % 2 = 0 AND row = 40 THEN '参考资料' || col::VARCHAR WHEN table_id % 2 = 1 AND row = 40 THEN 'x' ELSE content END AS content FROM cells),
 k AS (SELECT table_id, row, CASE WHEN col > 2 THEN col - 1 ELSE col END AS col, content FROM sc WHERE col <> 2)"""


@query(_SERIAL + f""", l1 AS (SELECT table_id, max(row) AS lr FROM k GROUP BY 1), b1 AS (SELECT k.table_id, lr FROM k JOIN l1 USING (table_id) WHERE row = lr GROUP BY 1, 2 HAVING min((length(content) = 1 OR content = '')::INT) = 1 AND lr > 0),
 k1 AS (SELECT k.* FROM k LEFT JOIN b1 ON b1.table_id = k.table_id AND b1.lr = k.row WHERE b1.lr IS NULL), l2 AS (SELECT table_id, max(row) AS lr FROM k1 GROUP BY 1),
 b2 AS (SELECT k1.table_id, lr FROM k1 JOIN l2 USING (table_id) WHERE row = lr GROUP BY 1, 2 HAVING min(contains(content, '参考资料')::INT) = 1 AND lr > 0)
 SELECT k1.table_id, k1.row, k1.col, CASE WHEN regexp_matches(k1.content, '^[^\\p{{L}}\\p{{N}}\\p{{M}}_]*$') THEN '' ELSE k1.content END AS content FROM k1 LEFT JOIN b2 ON b2.table_id = k1.table_id AND b2.lr = k1.row WHERE b2.lr IS NULL""")
def t17_clean(spark, d):
    c = F.when((F.col("row") == 0) & (F.col("col") == 2), "序号").when((F.col("row") == 40) & (F.col("table_id") % 2 == 0), F.concat(F.lit("参考资料"), F.col("col").cast("string")))
    c = c.when((F.col("row") == 40) & (F.col("table_id") % 2 == 1), "x").otherwise(F.col("content"))
    return tables.clean(cust_cells(spark, d).withColumn("content", c)).select("table_id", "row", "col", "content")


_BODY = _CELLS + ", h AS (SELECT table_id, col, content AS prop FROM cells WHERE row = 0), rec AS (SELECT c.table_id, c.row, h.prop, c.content AS value FROM cells c JOIN h USING (table_id, col) WHERE c.row > 0 AND trim(c.content) <> '')"


@query(_BODY + " SELECT table_id, row, prop, value FROM rec")
def t18_records_eav(spark, d):
    return tables.records(cust_cells(spark, d))


@query(_BODY + ", j AS (SELECT table_id, row, '{' || string_agg('\"' || prop || '\":\"' || value || '\"', ',' ORDER BY prop) || '}' AS j FROM rec GROUP BY 1, 2) SELECT table_id, '[' || string_agg(j, ',' ORDER BY row) || ']' AS json FROM j GROUP BY 1")
def t19_json(spark, d):
    return tables.to_json(cust_cells(spark, d))


@query(_CELLS + ", l AS (SELECT table_id, row, string_agg(content, ',' ORDER BY col) AS l FROM cells GROUP BY 1, 2) SELECT table_id, string_agg(l, chr(10) ORDER BY row) AS dump FROM l GROUP BY 1")
def t20_dump(spark, d):
    return tables.dump(cust_cells(spark, d))


# ---- classification --------------------------------------------------------------------------------------------------
# Six kinds of tables by their number: header variants and captions.
_KINDS = {0: ("姓名", "关系", "无题"), 1: ("姓名", "职务", "妻妾"), 2: ("姓名", "职务", "表"), 3: ("编年", "事件", "表"), 4: ("女儿", "兄弟", "表"), 5: ("民族", "国籍", "表")}


def _kind_cells(spark: SparkSession, d: str) -> DataFrame:
    """The names and relations of all customers as two-column tables of six kinds; for the last kind each customer is a table of its own."""
    r = cust_rows(spark, d).withColumn("kind", F.col("table_id") % 6)
    own = F.col("kind") == 5
    r = r.withColumn("table_id", F.when(own, F.col("v2").cast("int") + 1_000_000).otherwise(F.col("table_id"))).withColumn("row", F.when(own, 1).otherwise(F.col("row")))

    def pick(i: int) -> Column:
        out = F.lit(None).cast("string")
        for n, v in _KINDS.items():
            out = F.when(F.col("kind") == n, v[i]).otherwise(out)
        return out

    body = r.selectExpr("table_id", "kind", "row", "stack(2, 0, v0, 1, v1) as (col, content)").withColumn("tag", F.lit("td"))
    heads = r.select("table_id", "kind").distinct().select("table_id", "kind", F.lit(0).alias("row"), F.posexplode(F.array(pick(0), pick(1))).alias("col", "content")).withColumn("tag", F.lit("th"))
    return body.unionByName(heads).withColumn("caption", pick(2)).withColumn("prefix", F.lit("传主")).drop("kind")


_KIND_ROWS = "(VALUES " + ", ".join(f"({n}, '{a}', '{b}', '{c}')" for n, (a, b, c) in _KINDS.items()) + ") kinds(kind, h0, h1, caption)"
_KCELLS = _ROWS + f""", kr AS (SELECT CASE WHEN kind = 5 THEN v2::INT + 1000000 ELSE table_id END AS table_id, CASE WHEN kind = 5 THEN 1 ELSE row END AS row, v0, v1, h0, h1, caption, kind FROM r JOIN {_KIND_ROWS} ON kind = table_id % 6),
 kc AS (SELECT table_id, row, 0 AS col, v0 AS content, caption, kind FROM kr UNION ALL SELECT table_id, row, 1, v1, caption, kind FROM kr
 UNION ALL SELECT DISTINCT table_id, 0, 0, h0, caption, kind FROM kr UNION ALL SELECT DISTINCT table_id, 0, 1, h1, caption, kind FROM kr), kt AS (SELECT DISTINCT table_id, kind FROM kc)"""


def _flag_query(column: str, kinds: tuple[int, ...]):
    sql = _KCELLS + f" SELECT table_id, kind IN ({', '.join(map(str, kinds))}) AS {column} FROM kt"
    return query(sql)


@query(_KCELLS + " SELECT table_id, CASE kind WHEN 0 THEN '属性关系表' WHEN 1 THEN '标题关系表' WHEN 2 THEN '实体关系表' WHEN 3 THEN '其他表' WHEN 4 THEN '属性关系表' ELSE '个人信息表' END AS table_type FROM kt")
def k1_table_type(spark, d):
    return tables.classify(_kind_cells(spark, d)).select("table_id", "table_type")


@_flag_query("is_info", (5,))
def k2_person_info(spark, d):
    return tables.classify(_kind_cells(spark, d)).select("table_id", "is_info")


@_flag_query("is_property", (0, 4))
def k3_property_rel(spark, d):
    return tables.classify(_kind_cells(spark, d)).select("table_id", "is_property")


@_flag_query("is_title", (1,))
def k4_title_rel(spark, d):
    return tables.classify(_kind_cells(spark, d)).select("table_id", "is_title")


@_flag_query("is_entity", (0, 1, 2))
def k5_entity_table(spark, d):
    return tables.classify(_kind_cells(spark, d)).select("table_id", "is_entity")


@query(_KCELLS + " SELECT table_id, 1 AS col, '关系' AS header, 0 AS priority FROM kt WHERE kind = 0")
def k6_rel_priority(spark, d):
    return tables.relation_columns(_kind_cells(spark, d))


@query(_KCELLS + " SELECT DISTINCT content AS word FROM kc WHERE kind = 5 AND row = 0 UNION SELECT w FROM (VALUES ('中文名'), ('本名'), ('别名'), ('国籍'), ('民族'), ('出生地'), ('出生日期'), ('所处时代')) x(w)")
def k7_dictionary_union(spark, d):
    return tables.dictionary_union(_kind_cells(spark, d))


@query(_KCELLS + " SELECT table_id, CASE WHEN kind IN (0, 1, 2) THEN 0 ELSE -1 END AS person_col FROM kt")
def k8_person_col(spark, d):
    return tables.person_column(_kind_cells(spark, d))


# ---- extraction ------------------------------------------------------------------------------------------------------
def _with_head(cells: DataFrame) -> DataFrame:
    return cells.withColumn("caption", F.lit("女儿")).withColumn("prefix", F.concat(F.lit("传主"), F.col("table_id").cast("string")))


_XNAME = "replace(v0, '#', '')"


@query(_KCELLS + """, p AS (SELECT table_id, row, kind, replace(content, '#', '') AS dst FROM kc WHERE kind IN (0, 1) AND row > 0 AND col = 0), v AS (SELECT table_id, row, content AS rel FROM kc WHERE col = 1)
 SELECT table_id, row, '传主' AS src, CASE kind WHEN 0 THEN rel ELSE '妻妾' END AS rel, dst FROM p JOIN v USING (table_id, row)""")
def e1_dispatch(spark, d):
    """Relationships of tables of all kinds, each by the rule of its type."""
    _, rels = extract.extract(_kind_cells(spark, d))
    return rels.select("table_id", "row", "src", "rel", "dst")


@query(_ROWS + f" SELECT table_id, row, {_XNAME} AS name, '' AS url, prop, value FROM (SELECT table_id, row, v0, '关系' AS prop, v1 AS value FROM r UNION ALL SELECT table_id, row, v0, '编号', v2 FROM r UNION ALL SELECT table_id, row, v0, '备注', v3 FROM r) WHERE value <> ''")
def e2_entities_eav(spark, d):
    return extract.entities(cust_cells(spark, d))


@query("SELECT substr(n_name, 8) || 'x' AS name, '区' AS prop, n_regionkey::VARCHAR AS value FROM nation")
def e3_triads(spark, d):
    n = table(spark, d, "nation")
    body = n.selectExpr("0 as table_id", "n_nationkey + 1 as row", "stack(2, 0, concat(substr(n_name, 8), 'x'), 1, cast(n_regionkey as string)) as (col, content)")
    head = spark.createDataFrame([(0, 0, 0, "姓名"), (0, 0, 1, "区")], "table_id int, row int, col int, content string")
    return extract.triads(body.unionByName(head)).select("name", "prop", "value")


@query(_ROWS + f" SELECT table_id, row, '传主' || table_id::VARCHAR AS src, v1 AS rel, {_XNAME} AS dst, '' AS dst_url FROM r WHERE length(v1) <= 7")
def e4_property_rel(spark, d):
    return extract.property_relations(_with_head(cust_cells(spark, d)))


@query(_ROWS + f" SELECT table_id, row, '传主' || table_id::VARCHAR AS src, '女儿' AS rel, {_XNAME} AS dst, '' AS dst_url FROM r")
def e5_caption_rel(spark, d):
    return extract.caption_relations(_with_head(cust_cells(spark, d)))


@query(_ROWS + f" SELECT table_id, col, '传主' AS src, CASE col WHEN 0 THEN '女儿' ELSE '兄弟' END AS rel, CASE col WHEN 0 THEN {_XNAME} ELSE v1 END AS dst FROM r CROSS JOIN (VALUES (0), (1)) x(col) WHERE table_id % 6 = 4 AND row = 1 AND length(v1) > 0")
def e6_header_rel(spark, d):
    return extract.header_relations(_kind_cells(spark, d))


@query(_ROWS + f" SELECT table_id, row, {_XNAME} AS person FROM r")
def e7_person_list(spark, d):
    return extract.person_names(cust_cells(spark, d))


@query(_SUP + " SELECT page_id, i + 1 AS row, replace(s_name, '#', '') AS name, 'https://baike.example.com/item/' || s_suppkey::VARCHAR AS url FROM s")
def e8_href_resolve(spark, d):
    return extract.persons(_parsed(spark, d, "table"), keys=["page_id"]).select("page_id", "row", "name", "url")


@query(_SUP + """ SELECT page_id, 'P' || page_id::VARCHAR AS src, substr(n_name, 1, 6) AS rel, replace(s_name, '#', '') AS dst, 'https://baike.example.com/item/' || s_suppkey::VARCHAR AS dst_url
 FROM (SELECT *, regexp_replace(n_name, ' ', '') AS m FROM s) WHERE substr(n_name, 1, 6) NOT LIKE '% %'
 UNION ALL SELECT page_id, 'P' || page_id::VARCHAR, replace(substr(n_name, 1, 6), ' ', ''), replace(s_name, '#', ''), 'https://baike.example.com/item/' || s_suppkey::VARCHAR FROM s WHERE substr(n_name, 1, 6) LIKE '% %'""")
def e9_end_to_end(spark, d):
    """Pages to relationships: parse, regular tables, direction, cleaning, classification, extraction."""
    _, rels = extract.pipeline(_parsed(spark, d), keys=["page_id", "table_id"])
    return rels.select("page_id", "src", "rel", "dst", "dst_url")


# ---- scalar functions ------------------------------------------------------------------------------------------------
_BRACKET_SQL = "regexp_replace({c}, '\\(.?\\)|（.*?）|\\{{.*?\\}}|\\[.*?\\]|【.*?】|<.*?>', '', 'g')"
_MARKS_SQL = "regexp_replace({c}, '[\\s\\p{{Z}}+.!/_,$%^*(\"''——！，。？?、~@#￥%……&*（）]+', '', 'g')"


def _clean_sql(c: str) -> str:
    return _MARKS_SQL.format(c=_BRACKET_SQL.format(c=c))


@query(f"SELECT row_id, {_clean_sql('name')} AS name, {_clean_sql('value')} AS value FROM entity_triad")
def x1_clean_name(spark, d):
    return table(spark, d, "entity_triad").select("row_id", N.clean_name(F.col("name")).alias("name"), N.clean_name(F.col("value")).alias("value"))


@query(f"SELECT row_id, {_MARKS_SQL.format(c='string_split(' + _BRACKET_SQL.format(c='value') + chr(44) + ' ' + chr(39) + '/' + chr(39) + ')[1]')} AS person FROM entity_triad WHERE value IS NOT NULL")
def x2_person_name(spark, d):
    return table(spark, d, "entity_triad").where("value is not null").select("row_id", N.person_name(F.col("value")).alias("person"))


_BLANK = "regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}]+', '', 'g') = ''"


@query(f"SELECT row_id FROM (SELECT row_id, {_clean_sql('name')} AS n, {_clean_sql('prop')} AS p, {_clean_sql('value')} AS v FROM entity_triad) WHERE NOT {_BLANK.format(c='n')} AND NOT {_BLANK.format(c='p')} AND NOT {_BLANK.format(c='v')} AND length(p) <= 7")
def x3_guard(spark, d):
    t = table(spark, d, "entity_triad")
    n, p, v = (N.clean_name(F.col(c)) for c in ("name", "prop", "value"))
    return t.where(N.relation_guard(n, p, v)).select("row_id")


@query(f"SELECT row_id FROM entity_triad WHERE NOT {_BLANK.format(c='name')} AND NOT {_BLANK.format(c='prop')} AND NOT {_BLANK.format(c='value')} AND length(name) <= 7 AND length(prop) <= 7")
def x4_triad_guard(spark, d):
    return table(spark, d, "entity_triad").where(N.triad_guard(F.col("name"), F.col("prop"), F.col("value"))).select("row_id")


@query("SELECT row_id, regexp_replace(value, '\\[\\d+\\]', '', 'g') AS value FROM entity_triad")
def x5_footnotes(spark, d):
    return table(spark, d, "entity_triad").select("row_id", N.strip_footnotes(F.col("value")).alias("value"))


@query("SELECT row_id, replace(prop, chr(160), '') AS prop FROM entity_triad")
def x6_nbsp(spark, d):
    return table(spark, d, "entity_triad").select("row_id", N.strip_nbsp(F.col("prop")).alias("prop"))


@query("SELECT p_partkey, regexp_replace(replace(p_name, ' ', '<BR />'), '(?i)<br\\s*/?>', '/', 'g') AS name FROM part")
def x7_breaks(spark, d):
    return table(spark, d, "part").select("p_partkey", N.breaks_to_slash(F.replace("p_name", F.lit(" "), F.lit("<BR />"))).alias("name"))


@query("SELECT id, url_decode(replace(url, '+', '%2B')) AS url FROM useless_url WHERE url IS NOT NULL")
def x8_url_decode(spark, d):
    return table(spark, d, "useless_url").where("url is not null").select("id", decode_percent(F.col("url")).alias("url"))


@query(f"SELECT page_id, href, ltrim(href, '/item/') AS rest FROM ({_HREFS})")
def x9_charset_strip(spark, d):
    return _links(spark, d).withColumn("rest", crawl.charset_stripped(F.col("href")))


@query("SELECT row_id, contains(c1, '友') AS friend, contains(c1, '父') AS father FROM relation_triad WHERE c1 IS NOT NULL")
def x10_contains(spark, d):
    return table(spark, d, "relation_triad").where("c1 is not null").select("row_id", F.col("c1").contains("友").alias("friend"), F.col("c1").contains("父").alias("father"))


@query("SELECT id, list_extract(string_split(url, '/'), -1) AS last, list_extract(string_split(url, '/'), -2) AS before FROM useless_url WHERE url IS NOT NULL")
def x11_segment(spark, d):
    p = F.split("url", "/")
    return table(spark, d, "useless_url").where("url is not null").select("id", F.try_element_at(p, F.lit(-1)).alias("last"), F.try_element_at(p, F.lit(-2)).alias("before"))


@query("SELECT row_id, ends_with(name, '氏') AS clan FROM entity_triad WHERE name IS NOT NULL")
def x12_clan_suffix(spark, d):
    return table(spark, d, "entity_triad").where("name is not null").select("row_id", F.col("name").endswith("氏").alias("clan"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"SELECT id, md5({_ESC.format('html')}) AS h FROM person_url_html WHERE html IS NOT NULL")
def x13_escape(spark, d):
    return table(spark, d, "person_url_html").where("html is not null").select("id", F.md5(N.escape_html(F.col("html"))).alias("h"))


@query("SELECT id, html AS same FROM person_url_html WHERE html IS NOT NULL")
def x14_unescape(spark, d):
    t = table(spark, d, "person_url_html").where("html is not null")
    return t.select("id", N.unescape_html(N.escape_html(F.col("html"))).alias("same"))


@query("SELECT event_id, json_extract_string(props, '$.' || key) AS value, key FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def x15_json_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    again = e.select("event_id", F.from_json(F.to_json("m"), "map<string,string>").alias("m"))
    return again.select("event_id", F.explode("m").alias("key", "value"))


@query("SELECT s_suppkey, array_to_string(list_transform(string_split(s_name, ''), lambda x: bin(ascii(x))), ' ') AS bits, s_name AS same FROM supplier")
def x17_codec(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", N.encode_bits(F.col("s_name")).alias("bits"), N.decode_bits(N.encode_bits(F.col("s_name"))).alias("same"))


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS sd, min(l_quantity) AS low, max(l_quantity) AS high, round(min(l_quantity) / max(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1")
def x18_stats(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(q), 4).alias("mean"), F.round(F.stddev_pop(q), 4).alias("sd"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.min(q) / F.max(q), 6).alias("ratio"))


@query("SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(p_type, ' ')))) AS common, len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))) AS together FROM part")
def x19_set_ops(spark, d):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("common"), F.size(F.array_union(a, b)).cast("long").alias("together"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS words FROM part")
def x20_sorted(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.split("p_name", " ")), " ").alias("words"))


# ---- graph -----------------------------------------------------------------------------------------------------------
_ENT = """WITH e AS (SELECT row_id AS seq, regexp_replace(name, '[\\s\\p{Z}]+|\\[\\d+\\]', '', 'g') AS name, 'u' || (row_id % 3)::VARCHAR AS u, prop, value FROM entity_triad WHERE name IS NOT NULL AND value IS NOT NULL),
 ent AS (SELECT seq, name, CASE u WHEN 'u0' THEN '' WHEN 'u1' THEN 'http://x/' || name ELSE 'http://x/' || name || '/1' END AS url, prop, value FROM e)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entity_triad").where("name is not null and value is not null")
    name = F.regexp_replace("name", r"(?U)[\s\p{Z}]+|\[\d+\]", "")
    k = F.col("row_id") % 3
    base = F.concat(F.lit("http://x/"), name)
    return t.select(F.col("row_id").alias("seq"), name.alias("name"), F.when(k == 0, "").when(k == 1, base).otherwise(F.concat(base, F.lit("/1"))).alias("url"), "prop", "value")


_REL = """, rel AS (SELECT row_id AS seq, 'P' || (row_id % 97)::VARCHAR AS src, coalesce(c1, '') AS rel, CASE WHEN row_id % 5 = 0 THEN '王氏' ELSE regexp_replace(regexp_extract(coalesce(c2, ''), '[\\x{4e00}-\\x{9fa5}]{3}'), ' ', '') END AS dst,
 CASE WHEN row_id % 2 = 0 THEN 'http://x/' || regexp_extract(coalesce(c2, ''), '[\\x{4e00}-\\x{9fa5}]{3}') ELSE '' END AS dst_url FROM relation_triad)"""


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_triad")
    k = F.col("row_id")
    name = F.regexp_extract(F.coalesce("c2", F.lit("")), "([一-龥]{3})", 1)
    return t.select(k.alias("seq"), F.concat(F.lit("P"), (k % 97).cast("string")).alias("src"), F.coalesce("c1", F.lit("")).alias("rel"), F.when(k % 5 == 0, "王氏").otherwise(name).alias("dst"), F.when(k % 2 == 0, F.concat(F.lit("http://x/"), name)).otherwise("").alias("dst_url"))


@query(_ENT + " SELECT name, prop, arg_min(value, seq) AS value FROM ent GROUP BY 1, 2")
def g1_nodes_by_name(spark, d):
    return graph.nodes_by_name(_entities(spark, d))


@query(_ENT + """, f AS (SELECT name, url, min(seq) AS seq FROM ent GROUP BY 1, 2), c AS (SELECT a.name, a.url, arg_min(b.url, b.seq) AS node_url FROM f a JOIN f b ON a.name = b.name AND (a.url = '' OR contains(a.url, b.url) OR contains(b.url, a.url)) GROUP BY 1, 2)
 SELECT ent.name, node_url, prop, arg_min(value, seq) AS value FROM ent JOIN c ON ent.name = c.name AND ent.url = c.url GROUP BY 1, 2, 3""")
def g2_nodes_by_url(spark, d):
    return graph.nodes_by_url(_entities(spark, d))


@query(_ENT + _REL + " SELECT seq, src, dst FROM rel WHERE NOT ends_with(dst, '氏')")
def g3_skip_suffix(spark, d):
    return graph.without_clans(_relationships(spark, d), name="dst").select("seq", "src", "dst")


@query(_ENT + ", p AS (SELECT name, prop, arg_min(value, seq) AS value FROM ent GROUP BY 1, 2) SELECT name, string_agg(prop || ':' || value, chr(10) ORDER BY prop) AS label FROM p GROUP BY 1")
def g4_fusion(spark, d):
    return graph.fuse(_entities(spark, d), ["name"]).select("name", graph.label_lines(F.col("props")).alias("label"))


@query(_ENT + _REL + """ SELECT seq, dst, dst_url, CASE WHEN EXISTS (SELECT 1 FROM ent WHERE ent.name = dst AND ent.url = dst_url) THEN 'exact' WHEN ends_with(dst, '氏') THEN 'fresh'
 WHEN EXISTS (SELECT 1 FROM ent WHERE ent.name = dst) THEN 'name' ELSE 'new' END AS how FROM rel""")
def g5_endpoints(spark, d):
    return graph.endpoints(_relationships(spark, d), _entities(spark, d))


@query(_ENT + _REL + " SELECT src, rel, dst, min(seq) AS seq FROM rel GROUP BY 1, 2, 3")
def g6_edges(spark, d):
    return graph.edges(_relationships(spark, d))


@query(_ENT + _REL + " SELECT src, rel, dst, seq FROM rel")
def g7_all_edges(spark, d):
    return graph.edges(_relationships(spark, d), keep_multi=True)


@query(_ENT + """, h AS (SELECT seq, name, url, string_agg(prop || ':' || value, chr(10) ORDER BY prop, value) AS label FROM ent GROUP BY 1, 2, 3),
 u AS (SELECT url, arg_min(name, (seq, name)) AS name, arg_min(label, (seq, name)) AS label, min(seq) AS seq FROM h GROUP BY 1)
 SELECT name, arg_min(url, (seq, url)) AS url, arg_min(label, (seq, url)) AS label FROM u GROUP BY 1""")
def g9_chart_nodes(spark, d):
    return graph.chart_nodes(_entities(spark, d))


@query(_ENT + _REL + ", f AS (SELECT url, arg_min(name, seq) AS n FROM ent WHERE url <> '' GROUP BY 1) SELECT seq, src, rel, coalesce(n, dst) AS dst FROM rel LEFT JOIN f ON f.url = rel.dst_url")
def g10_chart_links(spark, d):
    return graph.chart_links(_relationships(spark, d), _entities(spark, d))


@query("SELECT o_custkey AS page, string_agg(p, ',' ORDER BY o_orderkey) AS items FROM (SELECT o_custkey, o_orderkey, o_orderstatus || ',' || o_orderpriority AS p FROM orders) GROUP BY 1")
def g11_flatten(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("items"))
    return graph.flatten_pages(o, "page", "items", "o_orderkey").select("page", F.array_join("items", ",").alias("items"))


# ---- serving ---------------------------------------------------------------------------------------------------------
_POPULAR = "(SELECT min(url) AS u FROM person_url_html WHERE url IS NOT NULL AND html IS NOT NULL)"


@query(f"SELECT id, url, length(html) AS n FROM person_url_html WHERE url = {_POPULAR}")
def v1_lookup(spark, d):
    p = table(spark, d, "person_url_html")
    first = p.where("url is not null and html is not null").agg(F.min("url").alias("_u"))
    return p.join(F.broadcast(first), F.col("url") == F.col("_u")).select("id", "url", F.length("html").alias("n"))


@query(_SUPCELLS + ", f AS (SELECT page_id FROM s WHERE s_suppkey = 0) SELECT row, col, content FROM cells WHERE page_id = (SELECT page_id FROM f)")
def v2_person_query(spark, d):
    """Tables of one person's page, parsed on demand."""
    page = supplier_pages(spark, d).where(last_segment(F.col("url")) == "P0")
    return html.parse_tables(page).where("kind = 'table'").select("row", "col", "content")


@query("SELECT id, url FROM (SELECT DISTINCT id, url FROM pending_url) ORDER BY id DESC LIMIT 200")
def v3_recent_200(spark, d):
    return table(spark, d, "pending_url").select("id", "url").distinct().orderBy(F.desc("id")).limit(200)


@query(_CELLS + """, l AS (SELECT table_id, row, '<tr>' || string_agg('<' || tag || '>' || content || '</' || tag || '>', '' ORDER BY col) || '</tr>' AS l FROM cells GROUP BY 1, 2)
 SELECT table_id, '<table>' || string_agg(l, '' ORDER BY row) || '</table>' AS html FROM l GROUP BY 1""")
def v4_render(spark, d):
    return sinks.html_tables(cust_cells(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return e9_end_to_end(spark, d)


# ---- streaming -------------------------------------------------------------------------------------------------------
def _folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _spool(df: DataFrame, path: str, files: int = 4) -> str:
    df.repartition(files).write.parquet(f"{path}/in")
    return f"{path}/in"


@query(_SUP + """, t AS (SELECT 'infobox' AS kind, 4 AS cells FROM n UNION ALL SELECT 'list', 2 * n FROM n UNION ALL SELECT 'table', 4 * (n + 1) FROM n) SELECT kind, sum(cells)::BIGINT AS cells FROM t GROUP BY 1""")
def s_extract_available_now(spark, d):
    """Pages as a stream of files, extracted batch by batch."""
    at = _folder(spark)
    src = _spool(supplier_pages(spark, d), at)
    jobs.extract_cells(jobs.queue_stream(spark, src, 2), f"{at}/out", f"{at}/cp")
    return spark.read.parquet(f"{at}/out").groupBy("kind").agg(F.count(F.lit(1)).alias("cells"))


@query(_ENT + " SELECT name, prop, arg_min(value, seq) AS value FROM ent GROUP BY 1, 2")
def s_graph_foreach_batch(spark, d):
    """The merged nodes after all batches equal those of one batch job."""
    at = _folder(spark)
    src = _spool(_entities(spark, d), at)
    jobs.build_graph(jobs.queue_stream(spark, src, 2), f"{at}/out", f"{at}/cp")
    return jobs.graph_state(spark, f"{at}/out")


@query(f"SELECT DISTINCT href FROM ({_HREFS})")
def s_dedup_links(spark, d):
    at = _folder(spark)
    src = _spool(table(spark, d, "person_url_html").select(F.col("id").alias("page_id"), "html"), at)
    jobs.links_once(jobs.queue_stream(spark, src, 2), f"{at}/cp", f"{at}/out")
    return spark.read.parquet(f"{at}/out").select("href")
