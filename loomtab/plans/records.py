"""Queries of the general data-preparation operators: nested records, packed values, attribute-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.operators import eav, multivalue, nested
from loomtab.session import table

#: Attributes of ``entity_triad`` whose values are lists of names, works, occupations or eras.
LIST_PROPS = ["别名", "又名", "别称", "字号", "年号", "主要作品", "代表作品", "作品", "代表作", "身份", "职业"]

#: Wide columns: type (None: as discovered) and the keys (see :func:`eav.attribute_key`) of the attributes that fill them.
PERSON = {
    "birth_date": (None, ["出生日期", "出生时间", "出生年月", "出生年份", "生日", "生年", "诞辰", "born", "birthdate", "dateofbirth"]),
    "death_date": (None, ["逝世日期", "逝世时间", "去世时间", "去世日期", "卒年", "卒日", "忌日", "died", "deathdate", "dateofdeath"]),
    "height_cm": (None, ["身高", "身长", "height"]),
    "weight_kg": (None, ["体重", "weight"]),
    "ethnic": (None, ["民族", "民族族群", "族别", "族群", "ethnicity", "ethnicgroup"]),
    "dynasty": (None, ["朝代", "时代", "所处时代", "所处朝代", "年代", "dynasty", "era"]),
    "birthplace": (None, ["出生地", "出生地点", "生地", "birthplace", "placeofbirth"]),
}


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "entity_relationship"), "id", {"entity": "entity", "relationship": "relationship"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d).where("path is not null").select("id", "field", "item_no", "path")


def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    return nested.persons(_flat(spark, d))


def p3_attributes(spark: SparkSession, d: str) -> DataFrame:
    return nested.attributes(_flat(spark, d))


def p3_relations(spark: SparkSession, d: str) -> DataFrame:
    return nested.relations(_flat(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entity_triad")
    return multivalue.split_values(t.where(eav.attribute_key(F.col("prop")).isin(LIST_PROPS)), "value", ["row_id"], least=2)


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "entity_triad").where(eav.attribute_key(F.col("prop")).isin(LIST_PROPS))
    return multivalue.split_values(t, "value", ["row_id", "name", "prop"])


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    return eav.discover(table(spark, d, "entity_triad"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """All attributes with the wide column each fills, those that fill none among them."""
    return eav.report(table(spark, d, "entity_triad"), PERSON)


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.widen(table(spark, d, "entity_triad"), PERSON)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.cells(p5_wide(spark, d), list(PERSON))


QUERIES = {f.__name__: f for f in (p3_found, p3_persons, p3_attributes, p3_relations, p4_found, p4_values, p5_found, p5_wide, p5_attributes, p5_report)}
ORACLE: dict[str, str] = {}

# ---- SQL -------------------------------------------------------------------------------------------------------------
_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_NOTES = r"regexp_replace({c}, '[\[［]\s*\d+\s*[\]］]', '', 'g')"
_KEY = r"lower(regexp_replace(" + _NOTES + r", '[\s\p{{Z}}:：]+', '', 'g'))"
_SPAN = "《[^《》]*》|“[^“”]*”|「[^「」]*」|『[^『』]*』|‘[^‘’]*’|\"[^\"]*\""
_DELIM = r"/／、,，;；|｜\s\p{Z}①-⑳⑴-⒇㈠-㈩"


def _p4_sql(columns: str = "row_id", least: int = 2) -> str:
    """An item is a run of quoted spans and characters that don't delimit; spaces between Latin words are kept aside."""
    kept = "value"
    for _ in range(2):
        kept = f"regexp_replace({kept}, '([A-Za-z.'']) +([A-Za-z])', '\\1' || chr(1) || '\\2', 'g')"
    props = ", ".join(f"'{p}'" for p in LIST_PROPS)
    quotes = "\"“”「」『』‘’"
    item = f"regexp_replace(replace(x, chr(1), ' '), '^[{quotes}]*[\\s\\p{{Z}}]*[{quotes}]*|[{quotes}]*[\\s\\p{{Z}}]*[{quotes}]*$', '', 'g')"
    return f"""WITH t AS (SELECT {columns}, {kept} AS v FROM entity_triad WHERE {_KEY.format(c='prop')} IN ({props})),
 i AS (SELECT {columns}, list_filter(list_transform(regexp_extract_all(v, '《[^《》]*》|(?:“[^“”]*”|「[^「」]*」|『[^『』]*』|‘[^‘’]*’|"[^"]*"|[^《{_DELIM}])+'), lambda x: {_STRIP.format(c=item)}), lambda x: x <> '') AS items FROM t)
 SELECT {columns}, unnest(range(1, len(items) + 1)) AS pos, unnest(items) AS item FROM i WHERE len(items) >= {least}"""


def _p5_sql(what: str) -> str:
    to = "CASE " + " ".join(f"WHEN k IN ({', '.join(repr(a) for a in names)}) THEN '{c}'" for c, (_, names) in PERSON.items()) + " END"
    n = "lower(translate(regexp_replace(v, '[\\s\\p{Z}]+', '', 'g'), '０１２３４５６７８９．－／', '0123456789.-/'))"
    d = "n"
    for a, b in (
        ("^公元([^前])", "\\1"), (r"^(\d{1,2})(?:st|nd|rd|th)?([a-z]{3})[a-z]*\.?,?(\d{1,4})$", r"\3-\2-\1"), (r"^([a-z]{3})[a-z]*\.?(\d{1,2}),(\d{1,4})$", r"\3-\1-\2"), (r"^(\d{4})(\d{2})(\d{2})$", r"\1-\2-\3"),
        (r"([\d〇零一二三四五六七八九])年", r"\1-"), ("月份?", "-"), ("[日号]$", ""), ("[./]", "-"), ("-$", ""),
    ):
        d = f"regexp_replace({d}, '{a}', '{b}', 'g')"
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    part = "CASE WHEN x = '十' THEN '10' WHEN x[1] = '十' THEN '1' || x[2:] WHEN x[-1] = '十' THEN x[:-2] || '0' WHEN contains(x, '十') THEN replace(x, '十', '') " + " ".join(f"WHEN x = '{m}' THEN '{i}'" for i, m in enumerate(months, 1)) + " ELSE x END"
    parts = f"list_transform(string_split({d}, '-'), lambda x: translate({part}, '〇零一二三四五六七八九', '00123456789'))"
    num = "try_cast({} AS DOUBLE)"
    cm = f"""CASE WHEN regexp_matches(n, '^\\d[米m]\\d{{2}}(?:厘米|公分|cm)?$') THEN n[1] || n[3:4] WHEN regexp_matches(n, '^\\d{{2,3}}(?:\\.\\d+)?(?:cm|厘米|公分)?$') THEN round({num.format("regexp_extract(n, '^[0-9.]+')")})::INT::VARCHAR
 WHEN regexp_matches(n, '^\\d(?:\\.\\d+)?(?:m|米|公尺)$') THEN round({num.format("regexp_extract(n, '^[0-9.]+')")} * 100)::INT::VARCHAR WHEN regexp_matches(n, '^\\d{{3,4}}(?:mm|毫米)$') THEN round({num.format("regexp_extract(n, '^[0-9]+')")} / 10)::INT::VARCHAR END"""
    kg = f"""CASE WHEN regexp_matches(n, '^\\d+(?:\\.\\d+)?(?:kg|kgs|千克|公斤)?$') THEN round({num.format("regexp_extract(n, '^[0-9.]+')")})::INT::VARCHAR WHEN regexp_matches(n, '^\\d+(?:\\.\\d+)?(?:斤|市斤)$') THEN round({num.format("regexp_extract(n, '^[0-9.]+')")} / 2)::INT::VARCHAR END"""
    unknown = r"(?i)^(?:[^\p{L}\p{N}\p{M}]*|.*(?:不详|未知|待考|不明|无考|失考|未详|存疑)|none|null|nan|n/a|unknown|无|暂无)$"
    whole = "array_to_string(p, '-')"
    date = f"CASE WHEN len(p) BETWEEN 1 AND 3 AND regexp_matches({whole}, '^\\d{{1,4}}(?:-\\d{{1,2}}){{0,2}}$') THEN array_to_string(list_concat([lpad(p[1], 4, '0')], list_transform(p[2:], lambda x: lpad(x, 2, '0'))), '-') END"
    real = "CASE WHEN try_cast(d || '-01-01'[len(d) - 3:] AS DATE) IS NOT NULL AND d[:4] <> '0000' THEN d END"
    a = f"a AS (SELECT row_id, {_STRIP.format(c=_NOTES.format(c='name'))} AS name, {_KEY.format(c='prop')} AS k, {_STRIP.format(c=_NOTES.format(c='value'))} AS v FROM entity_triad)"
    if what == "attributes":
        return f"""WITH {a}, b AS (SELECT k AS attr, CASE WHEN NOT regexp_matches(v, '{unknown}') THEN v END AS v FROM a WHERE k <> ''),
 c AS (SELECT *, {parts} AS p, CASE WHEN ({cm})::INT BETWEEN 20 AND 300 THEN 1 END AS cm, CASE WHEN ({kg})::INT BETWEEN 1 AND 700 THEN 1 END AS kg FROM (SELECT *, {n} AS n FROM b)), e AS (SELECT *, {date} AS d FROM c),
 g AS (SELECT attr, count(v) AS n, count({real}) AS n_date, count(cm) AS n_cm, count(kg) AS n_kg FROM e GROUP BY 1)
 SELECT *, CASE WHEN n = 0 THEN 'text' WHEN n_date >= n / 2 AND n_date >= greatest(n_cm, n_kg) THEN 'date' WHEN n_cm >= n / 2 AND n_cm >= n_kg THEN 'cm' WHEN n_kg >= n / 2 THEN 'kg' ELSE 'text' END AS type FROM g"""
    f = f"""WITH {a},
 b AS (SELECT row_id, name, {to} AS attr, v, {n} AS n FROM a WHERE name <> '' AND NOT regexp_matches(v, '{unknown}')),
 c AS (SELECT *, CASE WHEN attr IN ('birth_date', 'death_date') THEN {parts} END AS p FROM b WHERE attr IS NOT NULL), e AS (SELECT *, {date} AS d FROM c),
 f AS (SELECT row_id, name, attr, CASE WHEN attr IN ('birth_date', 'death_date') THEN {real} WHEN attr = 'height_cm' THEN {cm} WHEN attr = 'weight_kg' THEN {kg} ELSE v END AS val FROM e)"""
    if what == "wide":
        return f + " SELECT name, " + ", ".join(f"arg_min(val, row_id) FILTER (WHERE attr = '{c}' AND val IS NOT NULL) AS {c}" for c in PERSON) + " FROM f GROUP BY 1"
    return f + " SELECT name, attr, arg_min(val, row_id) AS val FROM f WHERE val IS NOT NULL GROUP BY 1, 2"


ORACLE["p4_found"] = _p4_sql()
ORACLE["p4_values"] = _p4_sql("row_id, name, prop", 1)
ORACLE["p5_found"] = _p5_sql("cells")
ORACLE["p5_wide"] = _p5_sql("wide")
ORACLE["p5_attributes"] = _p5_sql("attributes")
