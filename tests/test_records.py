"""Nested records, packed values, attribute-value tables."""

import html
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtab.operators import eav, multivalue, nested


def paths(s, want="entity"):
    return [(r[0], r[1]) for r in nested.parse_fields([s], want)[0] if r[1] is not None]


ITEM = [["甲[1]", "http://x/1"], {"k": [{"m": 1}, {"m": True}], "e": "", "n": None, "o": {}, "q": 'a"b\\c,[{'}]
WANT = [(0, "k[0].m"), (0, "k[1].m"), (0, "e"), (0, "q")]


def test_encodings_of_one_content():
    plain = json.dumps([ITEM], ensure_ascii=False)
    for s in (plain, json.dumps([ITEM], indent=4), html.escape(plain), json.dumps(plain), json.dumps({"v": 1, "tables": [{"c": None, "entities": [ITEM]}]}), repr([ITEM])):
        assert sorted(paths(s)) == sorted(WANT), s


def test_items_are_numbered_through_all_documents_and_lists():
    two = json.dumps([ITEM, ITEM])
    assert {n for n, _ in paths(two + "\n" + two)} == {0, 1, 2, 3}
    assert {n for n, _ in paths(json.dumps(two) + " " + two)} == {0, 1, 2, 3}


def test_incomplete_fields_give_no_row():
    s = json.dumps([ITEM, ITEM], ensure_ascii=False)
    for cut in range(1, len(s)):
        assert paths(s[:cut]) == []
    assert paths(s + s[:-1]) == [] and paths(json.dumps(s[:-2])) == [] and paths(html.escape(s)[:-1]) == []
    for s in (None, "", "  ", "[]", "{}", "null", "[}", '["a"'):
        assert paths(s) == []


def test_repeated_key_counts_once():
    assert paths('[[["a","u"],{"k":1,"k":2}]]') == [(0, "k")]


def test_relationships():
    s = json.dumps([[["a", "u"], "父", ["b", ""]], [["a", "u"], None, ["c", "v"]]])
    assert [r[:2] for r in nested.parse_fields([s], "relationship")[0]] == [(0, "父"), (1, "")]


values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text(alphabet='ab"\\,[]{}:中 \n', max_size=6)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(alphabet='k"\\[.', min_size=1, max_size=3), x, max_size=3)), max_leaves=8)


def leaves(o, p=""):
    if isinstance(o, dict):
        for k, v in o.items():
            yield from leaves(v, f"{p}.{k}" if p else k)
    elif isinstance(o, list):
        for i, v in enumerate(o):
            yield from leaves(v, f"{p}[{i}]")
    elif o is not None:
        yield p


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text(alphabet="ab中", min_size=1, max_size=2), values, max_size=3), max_size=3), st.booleans())
def test_against_json(objects, pretty):
    s = json.dumps([[["n", "u"], o] for o in objects], indent=2 if pretty else None, ensure_ascii=pretty)
    want = sorted((i, p) for i, o in enumerate(objects) for p in leaves(o))
    assert sorted(paths(s)) == want


def test_flatten_keeps_links(spark):
    rows = [(1, json.dumps([ITEM]), None), (2, None, json.dumps([[["a", "u"], "r", ["b", ""]]])), (3, "[[", ""), (1, json.dumps([ITEM]), None)]
    flat = nested.flatten(spark.createDataFrame(rows, "id long, entity string, relationship string").selectExpr("*", "'x' as path"), "id", {"entity": "entity", "relationship": "relationship"})
    assert flat.where("path is not null").count() == 9
    assert [tuple(r) for r in nested.relations(flat).collect()] == [(2, 0, "a", "u", "r", "b", "")]
    assert nested.persons(flat).count() == 2
    assert nested.flatten(spark.createDataFrame([], "id long, entity string, relationship string"), "id", {"entity": "entity"}).count() == 0


def split(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, value string")
    out = {i: [] for i in range(len(values))}
    for r in multivalue.split_values(df, "value", ["row_id"]).orderBy("row_id", "pos").collect():
        assert r["pos"] == len(out[r["row_id"]]) + 1
        out[r["row_id"]].append(r["item"])
    return list(out.values())


def test_packed_values(spark):
    cases = {
        "甲/乙、丙，丁": ["甲", "乙", "丙", "丁"], '小未\n"湄洲、甲"\n簋': ["小未", "湄洲、甲", "簋"], "《山、舟》|《渐》": ["《山、舟》", "《渐》"], "①甲②“乙;本”③丙": ["甲", "乙;本", "丙"],
        "钲壮子/": ["钲壮子"], "J. Sarpel": ["J. Sarpel"], "Dra Fen/Fen": ["Dra Fen", "Fen"], "成素 “意风” 辉念": ["成素", "意风", "辉念"], "/、,": [], "a0b/c": ["a0b", "c"],
        "1. 甲 2. 乙": ["甲", "乙"], "《甲》《乙》": ["《甲》", "《乙》"], '"未完/甲': ["未完", "甲"], None: [], "  ": [], "甲/甲": ["甲", "甲"],
    }
    assert split(spark, list(cases)) == list(cases.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="甲乙丙丁a", min_size=1, max_size=4), min_size=1, max_size=5), st.sampled_from(["/", "、", "，", ";", "\t"]))
def test_packed_round_trip(spark, items, delimiter):
    assert split(spark, [delimiter.join(items), delimiter.join(f"“{x}{delimiter}甲”" for x in items)]) == [items, [f"{x}{delimiter}甲" for x in items]]


def test_dates(spark):
    cases = {
        "公元1108年1月16日": "1108-01-16", "10 August 1529": "1529-08-10", "1108-11": "1108-11", "一二四四年七月十四日": "1244-07-14", "八〇八年十月三十日": "0808-10-30", "10570604": "1057-06-04", "４９９年４月１１日": "0499-04-11",
        "346.12": "0346-12", "896年": "0896", "718": "0718", "622-00-23": None, "1143年13月2日": None, "417年2月31日": None, "1900年2月29日": None, "2000/2/29": "2000-02-29", "不详": None, "1938 年 10 月 27 日": "1938-10-27", "二十年": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["d"] for r in df.select("v", eav.to_date_text(df["v"]).alias("d")).collect()}
    assert {k: v for k, v in got.items() if cases[k] != v and k != "二十年"} == {}


def test_wide_table(spark):
    rows = [
        (3, "甲", "身高", "1米67"), (1, " 甲[2]", "身 高：", "不详"), (2, "甲", "Height", "170cm[3]"), (4, "甲", "体重", "128斤"), (5, "乙", "生年", "622-00-23"), (6, "乙", "出生日期", "623年"), (7, None, "身高", "160"),
        (8, "丙", None, "x"), (9, "丙", "籍贯", "某地"), (2, "甲", "Height", "170cm[3]"), (10, "", "身高", "160"), (11, "丁", "身高", "中等"),
    ]
    spec = {"height": ("cm", ["身高", "height"]), "weight": ("kg", ["体重"]), "born": ("date", ["生年", "出生日期"]), "none": ("text", ["没有"])}
    df = spark.createDataFrame(rows, "row_id long, name string, prop string, value string").selectExpr("*", "1 as _e", "2 as attr")
    got = sorted(tuple(r) for r in eav.cells(eav.widen(df, spec), list(spec)).collect())
    assert got == [("乙", "born", "0623"), ("甲", "height", "170"), ("甲", "weight", "64")]
    kinds = {r["attr"]: r["type"] for r in eav.discover(df).collect()}
    assert kinds["体重"] == "kg" and kinds["籍贯"] == "text" and kinds["height"] == "cm"
    assert eav.widen(df.limit(0), spec).count() == 0


def test_attributes_left_over_are_reported(spark):
    rows = [(1, "甲", "身高", "170cm"), (2, "甲", "身髙", "171cm"), (3, "甲", "体重", "高大"), (4, "乙", "体重", "魁梧"), (5, "乙", "籍贯", "某地"), (6, "乙", " ", "x")]
    df = spark.createDataFrame(rows, "row_id long, name string, prop string, value string")
    got = {r["attr"]: (r["n"], r["type"], r["column"], r["status"]) for r in eav.report(df, {"height": ("cm", ["身高"]), "weight": ("kg", ["体重", "weight"])}).collect()}
    assert got == {"身高": (1, "cm", "height", "mapped"), "身髙": (1, "cm", None, "unmapped"), "体重": (2, "text", "weight", "other type"), "籍贯": (1, "text", None, "unmapped"), "weight": (None, None, "weight", "absent")}


def test_types_are_discovered(spark):
    rows = [(1, "甲", "身高", "180cm"), (2, "乙", "身高：", "1米75"), (3, "甲", "鞋码", "四十二"), (4, "甲", "建档日期", "1999年3月2日"), (5, "乙", "建档 日期[2]", "2001/4"), (6, "乙", "建档日期", "不详"), (7, "丙", "建档日期", "随口"), (8, None, "身高", "170cm")]
    df = spark.createDataFrame(rows, "row_id long, name string, prop string, value string")
    wide = eav.widen(df, {"filed": (None, ["建档日期"]), "height": (None, ["身高"]), "shoe": (None, ["鞋码"]), "none": (None, ["无此项"])})
    got = {r["name"]: (r["filed"], r["height"], r["shoe"], r["none"]) for r in wide.collect()}
    assert got == {"甲": ("1999-03-02", "180", "四十二", None), "乙": ("2001-04", "175", None, None), "丙": (None, None, None, None)}
    as_text = {r["name"]: r["filed"] for r in eav.widen(df, {"filed": ("text", ["建档日期"])}).collect()}  # overridden
    assert as_text == {"甲": "1999年3月2日", "乙": "2001/4", "丙": "随口"}


def test_only_wanted_leaves(spark):
    text = '[[["甲", "u/1"], {"父亲": "乙", "简介": "丙", "职": [{"名": "丁"}]}]]'
    df = spark.createDataFrame([(1, text)], "id long, entity string")
    got = [(r["kind"], r["path"]) for r in nested.flatten(df, "id", {"entity": "entity"}, r"^父亲$|名$").collect()]
    assert got == [("item", None), ("string", "父亲"), ("string", "职[0].名")]
