"""Queries of the operators for training data, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.functions.urls import page_key
from loomtab.llm import collapse, leakage, mainbody, matching, packing, seen, topics
from loomtab.operators import multivalue
from loomtab.session import cut, table


#: Attributes of a person that name other persons, and those that name the person itself.
KIN = ["父亲", "母亲", "养父", "养母", "妻子", "丈夫", "师父"]
OWN_NAMES = r"^(?:别名|别称|字号|又名|本名|中文名|曾用名)(?:\[\d+\])?$"
REMARKS = r"^(?:字号|出生地|所处时代)(?:\[\d+\])?$"
COMPANIONS = r"同僚\[\d+\]\.姓名$"


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of numbers with the rule that found them and its confidence."""
    kin = {rf"^{p}\Z": p for p in KIN} | {COMPANIONS: "同僚"}
    known = cut(matching.facts(table(spark, d, "entity_relationship"), kin, OWN_NAMES, REMARKS))
    of = lambda part: known.where(F.col("part").bitwiseAND(part) != 0)
    # a text of nothing but letters is one item
    items = F.when(F.col("value").rlike(r"^\p{L}+$"), F.array("value")).otherwise(multivalue.items(F.col("value")))
    aliases, remarks = (of(part).select("a", F.explode(items).alias(name)) for part, name in ((matching.OWN, "alias"), (matching.REMARK, "remark")))
    kin = of(matching.KIN).select("a", F.col("k").alias("own"), "cls", "word", F.col("value").alias("k"), "no")
    names_a, kin_a = matching.source_a(of(matching.ITEM).select("a", "k"), kin, aliases, remarks)
    names_b, kin_b = matching.source_b(table(spark, d, "relation_triad"))
    return matching.match(names_a, kin_a, names_b, kin_b)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select(F.col("a").alias("er_no"), F.col("b").alias("tri_no"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.blocks(table(spark, d, "person_url_html")).select("id", "block_md5")


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page as one text."""
    b = mainbody.blocks(table(spark, d, "person_url_html"))
    return b.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("body"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "pending_url"), table(spark, d, "useless_url"), page_key(F.col("url")))


def p6_rate(spark: SparkSession, d: str) -> DataFrame:
    pending, useless = table(spark, d, "pending_url"), table(spark, d, "useless_url")
    return seen.error_report(p6_found(spark, d), pending, useless, page_key(F.col("url")))


def p6_store(spark: SparkSession, d: str) -> DataFrame:
    """The encoded store after both tables, one row per part."""
    key = page_key(F.col("url"))
    store = seen.merge_store(seen.build_store(table(spark, d, "useless_url"), key), table(spark, d, "pending_url"), key)
    return store.select("part", "n", "low_bits", (F.octet_length("low") + F.octet_length("high")).alias("bytes"))


def _statement():
    return F.concat_ws("\x02", collapse.endpoint_key(F.col("c0")), collapse.letters(F.col("c1")), collapse.endpoint_key(F.col("c2")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse.copies(collapse.statements(table(spark, d, "relation_triad"), "row_id", "c0", "c1", "c2"), F.col("key"), "id")


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each statement, as in its earliest row, with its number of copies."""
    t = table(spark, d, "relation_triad")
    kept = collapse.collapse(collapse.statements(t, "row_id", "c0", "c1", "c2"), F.col("key"), "id")
    return kept.join(t.select(F.col("row_id").alias("keep_id"), "c0", "c1", "c2"), "keep_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id").distinct()


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents that held passages, without the spans that stem from them."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    spans = leakage.leaked_spans(docs, items)
    return leakage.remove_spans(docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text"), spans)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.measure(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


def _model(spark: SparkSession, d: str):
    return topics.fit(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return topics.assign(table(spark, d, "documents"), _model(spark, d)).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of the corpus by subject."""
    got = topics.assign(table(spark, d, "documents"), _model(spark, d))
    return got.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences"))


def p10_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their subjects and top terms, for inspection."""
    model = _model(spark, d)
    rows = topics.topic_table(model) if model else []
    return spark.createDataFrame(rows, "topic int, subject string, weight double, top_terms string")


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_text, p6_found, p6_rate, p6_store, p7_found, p7_records, p8_containers, p8_fill, p9_found, p9_cleaned, p10_found, p10_composition, p10_topics)}

def _page_sql(t: str) -> str:
    """SQL of :func:`loomtab.functions.urls.page_key`."""
    u = r"regexp_replace(url, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
    pattern = "'^(?:(?i:(https?))://)?([^/?#]*)([^?#]*)'"
    return f"""(SELECT id, u <> '' AS given, regexp_replace(lower(regexp_extract(u, {pattern}, 2)), CASE lower(regexp_extract(u, {pattern}, 1)) WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE '^$' END, '')
      || regexp_replace(url_decode(replace(regexp_extract(u, {pattern}, 3), '+', '%2B')), '/$', '') AS k FROM (SELECT id, {u} AS u FROM {t}))"""


ORACLE = {
    "p6_found": f"""
WITH p AS (SELECT id, k FROM {_page_sql('pending_url')} WHERE given), e AS (SELECT DISTINCT k FROM {_page_sql('useless_url')} WHERE given),
f AS (SELECT k, min(id) AS first FROM p GROUP BY k)
SELECT p.id FROM p JOIN f ON p.k = f.k LEFT JOIN e ON p.k = e.k WHERE e.k IS NOT NULL OR p.id > f.first""",
}

_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_URL = r"""https?://[^\s'"‘’“”|,，\[\]［］()（）]+"""


def _endpoint_sql(c: str) -> str:
    url = _URL.replace("'", "''")
    s = f"lower(coalesce({c}, ''))"
    return _LETTERS.format(f"regexp_replace({s}, '{url}', '', 'g')") + " || chr(1) || " + _LETTERS.format(f"regexp_extract({s}, '{url}')")


_KEYED = f"SELECT row_id, {_endpoint_sql('c0')} || chr(2) || {_LETTERS.format(chr(99) + '1_')} || chr(2) || {_endpoint_sql('c2')} AS k FROM (SELECT *, coalesce(c1, '') AS c1_ FROM relation_triad)"
ORACLE["p7_found"] = f"WITH r AS ({_KEYED}), g AS (SELECT *, min(row_id) OVER (PARTITION BY k) AS keep_id FROM r) SELECT keep_id, row_id AS copy_id FROM g WHERE row_id > keep_id"
ORACLE["p7_records"] = f"WITH r AS ({_KEYED}), g AS (SELECT min(row_id) AS keep_id, count(*) AS copies FROM r GROUP BY k) SELECT keep_id, copies, c0, c1, c2 FROM g JOIN relation_triad ON row_id = keep_id"
