"""Cell types, table algebra, pages, extraction, graph, streaming."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from loomtab.config import COL, INFO, PROPERTY, ROW, Config
from loomtab.functions import celltypes as C
from loomtab.functions import names as N
from loomtab.functions.urls import page_key
from loomtab.operators import crawl, extract, graph, html, skew, tables
from loomtab.sources import files, queues, sinks
from loomtab.streaming import jobs


def test_cell_types(spark):
    cases = {
        "": "标点类型", "——": "标点类型", "0": "<=0", "007": "数字类型", "12": ">=1", "5岁": "数字类型", "-5": "其他类型", "0.5": "其他类型", "50%": "其他类型", "中文": "中文", "ABC": "大写", "abc": "小写", "aBc": "大小写混合",
        "第1名": "字符类型", "a b": "其他类型", "_": "其他类型", "http://x.y/z": "超链接",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["t"] for r in df.select("v", C.cell_type(F.col("v")).alias("t")).collect()} == cases


def test_tree_distance_is_a_metric():
    assert [C.tree_distance(*p) for p in (("中文", "中文"), ("中文", "大写"), ("大写", "小写"), ("中文", ">=1"), ("超链接", "图片"), ("大写", "超链接"))] == [0, 3, 2, 4, 2, 5]
    for a in C.PARENT:
        for b in C.PARENT:
            assert C.tree_distance(a, b) == C.tree_distance(b, a)
            assert all(C.tree_distance(a, b) <= C.tree_distance(a, c) + C.tree_distance(c, b) for c in C.PARENT)


def test_names(spark):
    df = spark.createDataFrame([("张三（字）[1]",), ("A.B C",), ("a(bc)d",), ("李-四",), (None,)], "v string")
    assert [r[0] for r in df.select(N.clean_name(F.col("v"))).collect()] == ["张三", "ABC", "abc)d", "李-四", None]
    assert spark.range(1).select(N.strip_prefix_chars(F.lit("/item/time"), "/item/")).first()[0] == ""
    assert spark.range(1).select(N.decode_bits(N.encode_bits(F.lit("aZ 9")))).first()[0] == "aZ 9"


def test_pretty_json(spark):
    got = spark.range(1).select(N.pretty_json(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).first()[0]
    assert [x.strip() for x in got.splitlines()] == ["{", '"a" : "1",', '"b" : "2"', "}"]


def test_page_keys(spark):
    same = ["http://A.com/x/1", "https://a.com:443/x/1/", " https://a.com/x/%31?q=1#f\n", "HTTP://a.com:80/x/1?"]
    other = ["https://a.com/X/1", "https://a.com:8080/x/1", "https://m.a.com/x/1", "https://a.com/x"]
    df = spark.createDataFrame([(u,) for u in same + other + [None, " "]], "u string")
    k = [r[0] for r in df.select(page_key(F.col("u"))).collect()]
    assert len(set(k[:4])) == 1 and len(set(k[3:8])) == 5 and k[8:] == [None, None]


def grid(spark, rows, tag="td", table_id=1):
    return spark.createDataFrame([(table_id, i, j, v, tag if isinstance(tag, str) else tag(i, j)) for i, r in enumerate(rows) for j, v in enumerate(r)], "table_id int, row int, col int, content string, tag string")


def cells_of(df):
    return sorted((r["row"], r["col"], r["content"]) for r in df.collect())


def test_algebra(spark):
    g = grid(spark, [["a", "b"], ["c", "d"], ["e", "f"]])
    assert cells_of(tables.flip(tables.flip(g))) == cells_of(g)
    assert cells_of(tables.drop_row(g, 1)) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "e"), (1, 1, "f")]
    assert cells_of(tables.drop_col(g, 0)) == [(0, 0, "b"), (1, 0, "d"), (2, 0, "f")]
    spans = spark.createDataFrame([(1, 0, 0, 2, 1, "A"), (1, 0, 1, 1, 1, "B"), (1, 1, 1, 9, 1, "C")], "table_id int, row int, col int, rowspan int, colspan int, content string")
    assert cells_of(tables.expand_spans(spans)) == [(0, 0, "A"), (0, 1, "B"), (1, 0, "A"), (1, 1, "C")]
    assert tables.shapes(grid(spark, [["a", "b"], ["c", "d", "e"]])).first()["is_correct"] is False
    assert tables.shapes(grid(spark, [["a", "b", "c"]])).first()["is_normal"] is False
    assert tables.dump(g).first()["dump"] == "a,b\nc,d\ne,f"
    assert tables.flip(g.limit(0)).count() == 0


def test_direction(spark):
    rows = [["姓名", "年龄", "注"], ["甲", "12", "长长长"], ["乙", "7", "短"]]
    assert tables.direction(grid(spark, rows, lambda i, j: "th" if i == 0 else "td")).first()["direction"] == ROW
    assert tables.direction(grid(spark, rows, lambda i, j: "th" if j == 0 else "td")).first()["direction"] == COL
    g = grid(spark, [["甲", "1234567", "x"], ["乙", "7654321", "y"], ["丙", "1111111", "z"]])
    a, b = tables.direction(g).first()["direction"], tables.direction(tables.flip(g)).first()["direction"]
    assert {a, b} == {ROW, COL}


def test_clean(spark):
    g = grid(spark, [["序号", "姓名", "备注"], ["1", "甲", "——"], ["2", "乙", "好"], ["参考资料", "参考资料", "参考资料"]])
    assert cells_of(tables.clean(g)) == [(0, 0, "姓名"), (0, 1, "备注"), (1, 0, "甲"), (1, 1, ""), (2, 0, "乙"), (2, 1, "好")]
    assert max(r[0] for r in cells_of(tables.clean(grid(spark, [["姓名", "备"], ["甲乙", "丙丁"], ["x", "y"]])))) == 1


PAGE = """<html><body><dl class="basic-info cmn-clearfix"><dt>中文名</dt><dd>传主[1]</dd><dt>别名<dd>甲<br>乙</dl>
<div class="title">亲属</div><table><tr><th>姓名</th><th>关系</th><th>简介</th></tr><tr><td><a href="/item/1">张三</a>[2]<td rowspan=5>父亲<td>好</tr><tr><td>李四</td><td>中</td></tr></table>
<table><tr><td>1</td></tr></table><script>"<table>"</script></body></html>"""


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"https://x/item/%E4%BC%A0/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def test_pages_to_relationships(spark):
    p = html.parse_tables(pages(spark, PAGE, None, "  ", "<table><tr><td", "no table"))
    kinds = {(r["page_id"], r["table_id"], r["kind"], r["caption"], r["prefix"]) for r in p.collect()}
    assert kinds == {(0, 0, "infobox", "未命名表格", "传"), (0, 1, "table", "亲属", "传")}
    assert cells_of(p.where("kind = 'infobox'")) == [(0, 0, "中文名"), (0, 1, "传主"), (1, 0, "别名"), (1, 1, "甲/乙")]
    assert p.where("preset is not null").select("preset").distinct().collect()[0][0] == INFO
    t = p.where("kind = 'table'")
    assert [c for r, c, v in cells_of(t) if v == "父亲"] == [1, 1]
    ents, rels = extract.pipeline(p, keys=["page_id", "table_id"])
    assert sorted((r["src"], r["rel"], r["dst"], r["dst_url"]) for r in rels.collect()) == [("传", "父亲", "张三", "https://baike.example.com/item/1"), ("传", "父亲", "李四", "")]
    assert ("张三", "简介", "好") in {(r["name"], r["prop"], r["value"]) for r in ents.collect()}


def test_classification(spark):
    g = grid(spark, [["姓名", "关系"], ["甲", "父"]]).withColumn("caption", F.lit("x"))
    assert tables.classify(g).first()["table_type"] == PROPERTY
    assert tables.relation_columns(g).first()["priority"] == 0
    assert tables.person_column(grid(spark, [["编年", "事"], ["1", "2"]])).first()["person_col"] == -1
    long = grid(spark, [["姓名", "关系"], ["甲", "一二三四五六七八"]]).withColumn("prefix", F.lit("P"))
    assert extract.property_relations(long).count() == 0


def test_crawl(spark):
    p = pages(spark, '<a href="/item/赵云/12"> <a href="/x"> <a class=c href=" /item/赵云/12 "> <a href="http://y">')
    got = {r["href"]: r["useful"] for r in crawl.route(crawl.links(p)).collect()}
    assert got == {"/item/赵云/12": True, "/x": False, "http://y": False}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    reach = crawl.reach(spark.createDataFrame([("a",)], "node string"), e, 5)
    assert {(r["node"], r["depth"]) for r in reach.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_graph(spark):
    e = spark.createDataFrame([(1, "王", "", "a", "1"), (2, "王", "http://w/1", "a", "2"), (3, "王", "http://w/1/2", "b", "3"), (4, "李", "u", "a", "4")], "seq long, name string, url string, prop string, value string")
    assert {tuple(r) for r in graph.nodes_by_name(e).collect()} == {("王", "a", "1"), ("王", "b", "3"), ("李", "a", "4")}
    assert {(r["name"], r["prop"], r["value"]) for r in graph.nodes_by_url(e).collect()} == {("王", "a", "1"), ("王", "b", "3"), ("李", "a", "4")}
    r = spark.createDataFrame([(1, "P", "", "妻", "王氏", ""), (2, "P", "", "妻", "王氏", ""), (3, "P", "", "友", "李", "u"), (4, "P", "", "友", "新", "")], "seq long, src string, src_url string, rel string, dst string, dst_url string")
    assert {(x["seq"], x["how"]) for x in graph.endpoints(r, e).collect()} == {(1, "fresh"), (2, "fresh"), (3, "exact"), (4, "new")}
    assert graph.edges(r).count() == 3 and graph.edges(r, True).count() == 4


def test_join_of_hot_groups(spark):
    rows = spark.range(3000).selectExpr("id", "cast(if(id % 3 = 0, 0, id) as string) as key")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    got = skew.join_groups(rows, groups, "key", "size", 3000, least=10)
    assert got.count() == 3000 and got.where("key = '0' and first <> 0").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("http://a\n\n http://b \n")
    assert [r[0] for r in files.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://a", "http://b"]
    (tmp_path / "c.json").write_text('{"relevance": 0.5, "relation_columns": ["x"]}')
    assert files.config_from(str(tmp_path / "c.json")) == Config(relevance=0.5, relation_columns=("x",))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>" for x in c) + "</w:tr>"
    os.mkdir(tmp_path / "w")
    with zipfile.ZipFile(tmp_path / "w/a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{row("题")}{row("姓名", "注")}{row("甲", "乙")}</w:tbl></w:body></w:document>')
    (tmp_path / "w/b.docx").write_text("no zip")
    got = files.word_tables(spark, str(tmp_path / "w"))
    good, bad = sinks.split_errors(got)
    assert cells_of(good) == [(0, 0, "姓名"), (0, 1, "注"), (1, 0, "甲"), (1, 1, "乙")] and good.first()["caption"] == "题" and bad.count() == 1


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("u", "<a>'x'</a>"), ("v", ""), ("w", None)], "url string, html string")
    sinks.append_pages(p, str(tmp_path / "p"))
    assert [r["html"] for r in spark.read.parquet(str(tmp_path / "p")).select(N.unescape_html(F.col("html")).alias("html")).collect()] == ["<a>'x'</a>"]
    t = spark.createDataFrame([("['a', 'u']", 'r"x', "['b', '']")], "c0 string, c1 string, c2 string")
    sinks.write_triples(t, str(tmp_path / "t"))
    assert files.triples(spark, str(tmp_path / "t")).collect() == t.collect()
    g = grid(spark, [["a<", "b"]]).withColumn("page_id", F.lit(5).cast("long"))
    sinks.write_tables(g, str(tmp_path / "c"))
    assert sinks.lookup(spark, str(tmp_path / "c"), 5).count() == 2 and sinks.lookup(spark, str(tmp_path / "c"), 6).count() == 0
    assert sinks.html_tables(g).first()["html"] == "<table><tr><td>a&lt;</td><td>b</td></tr></table>"
    q = spark.createDataFrame([(1, "a"), (2, "b")], "id long, url string")
    new = spark.createDataFrame([(3, "c")], "id long, url string")
    assert queues.capped_append(q, new, 2).count() == 3 and queues.capped_append(q, new, 1).count() == 2


def test_streams_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    pages(spark, PAGE, PAGE).repartition(2).write.parquet(src)
    jobs.extract_cells(jobs.queue_stream(spark, src, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == html.parse_tables(pages(spark, PAGE, PAGE)).count()
    e = spark.createDataFrame([(i, f"n{i % 3}", "p", str(i)) for i in range(9)], "seq long, name string, prop string, value string")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    jobs.build_graph(jobs.queue_stream(spark, str(tmp_path / "e"), 1), str(tmp_path / "g"), str(tmp_path / "gc"))
    assert sorted(tuple(r) for r in jobs.graph_state(spark, str(tmp_path / "g")).collect()) == sorted(tuple(r) for r in graph.nodes_by_name(e).collect())


def test_pages_in_any_escaping(spark):
    import html as h

    plain = "<div><a href='/item/%E7%94%B2/1'>甲</a><A HREF=/item/x >x</A><a href=\"/q?a=1\">q</a><table><tr><th>姓名</th><th>关系</th></tr><tr><td>甲</td><td>友</td></tr></table></div>"
    rows, s = [(0, "u", plain), (8, "u", None), (9, "u", "no markup &amp; so")], plain
    for k in range(1, 6):
        s = h.escape(s)
        rows.append((k, "u", s))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in crawl.links(df).collect():
        got.setdefault(r["page_id"], set()).add(r["href"])
    assert got == {k: {"/item/%E7%94%B2/1", "/item/x", "/q?a=1"} for k in range(6)}
    cells = html.parse_tables(df).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in cells} == {k: 4 for k in range(6)}


def test_joins_that_spread_hot_numbers(spark):
    from loomtab.operators.skew import hot_keys, join_unique

    rows = spark.range(40_000).selectExpr("cast(if(id % 3 = 0, 7, id) as long) as k", "id as v")
    hot = hot_keys({"k": rows.select("k"), "v": rows.select("v")})
    assert hot == {"k": [7], "v": []}
    lookup = spark.range(0, 40_000, 2).selectExpr("id + 1 as k", "id as w")
    assert join_unique(rows, lookup, "k", hot["k"]).exceptAll(rows.join(lookup, "k")).count() == 0
    assert join_unique(rows, lookup, "k", hot["k"]).count() == rows.join(lookup, "k").count()
