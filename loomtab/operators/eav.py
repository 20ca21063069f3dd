"""Attribute-value rows into a wide, typed table.

Two passes: :func:`discover` lists the attributes and infers a type for each from all of their values;
:func:`widen` then pivots with one conditional aggregation per attribute. Which attributes fill which column is the
caller's choice; a column's type is the one discovered from the values of its attributes, unless the caller overrides it.
:func:`report` holds the choice against all attributes and types discovered. A duplicate is resolved explicitly: of the
values that can be cast, the one in the row with the lowest order column wins (ties: the lowest value). The
aggregation is combined before its only shuffle, so that one entity with a third of all rows costs one row per task.

Defined cases: null or blank entity, attribute or value rows fill nothing; a value that can't be cast to the
attribute's type (unknown marks, impossible dates, words instead of measures) fills nothing; repeated rows count
once; an empty table gives an empty result; columns besides the four named ones are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.text import BLANKS, clean, no_footnotes, no_space

UNKNOWN = r"(?iU)^(?:[\W_]*|none|null|nan|n/a|unknown|无|暂无)$|(?:不详|未知|待考|不明|无考|失考|未详|存疑)$"


def attribute_key(c: Column) -> Column:
    """An attribute's name without white space, colons and footnote marks, in lower case."""
    return F.lower(F.translate(no_space(no_footnotes(c)), ":：", ""))


def known(c: Column) -> Column:
    """A cleaned value, null where it is blank or says that the fact is unknown."""
    v = clean(c)
    return F.when(~v.rlike(UNKNOWN), v)


def _let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: White space goes, full-width digits and separators become plain.
_FROM, _TO = "０１２３４５６７８９．－／" + BLANKS, "0123456789.-/"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _chain(v: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, to in steps:
        v = F.regexp_replace(v, pattern, to)
    return v


def _english(v: Column) -> Column:
    v = _chain(v, ((r"^(\d{1,2})(?:st|nd|rd|th)?([a-z]{3})[a-z]*\.?,?(\d{1,4})$", "$3-$2-$1"), (r"^([a-z]{3})[a-z]*\.?(\d{1,2}),(\d{1,4})$", "$3-$1-$2")))
    for i, m in enumerate(_MONTHS, 1):
        v = F.replace(v, F.lit(f"-{m}-"), F.lit(f"-{i}-"))
    return v


def _han(v: Column) -> Column:
    """年, 月, 日 as separators; then numbers in characters, by place or with 十."""
    v = _chain(v, ((r"^公元(?!前)", ""), (r"(?<=[\d〇零一二三四五六七八九])年|月份?", "-"), (r"[日号]$", ""), (r"-$", "")))
    tens = ((r"(?<=-|^)十(?=-|$)", "10"), (r"(?<=-|^)十", "1"), (r"十(?=-|$)", "0"), (r"(?<=[二三])十", ""))
    number = lambda x: F.translate(F.when(x.contains("十"), _chain(x, tens)).otherwise(x), "〇零一二三四五六七八九", "00123456789")
    return _let(v, lambda x: F.when(x.rlike(r"^[\d-]+$"), x).otherwise(number(x)))


def to_date_text(c: Column) -> Column:
    """'YYYY-MM-DD', 'YYYY-MM' or 'YYYY' of many notations; null if none fits or the date doesn't exist.

    Each notation is rewritten to numbers joined by '-' by its own steps, and the numbers are checked once.
    """

    def plain(v: Column) -> Column:
        digits = _chain(v, ((r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), (r"[./]", "-")))
        return F.when(v.rlike("[a-z]"), _english(v)).when(v.rlike("[年月公]"), _han(v)).when(v.rlike(r"^\d"), digits)

    v = _let(F.lower(F.translate(c, _FROM, _TO)), plain)

    def check(p: Column) -> Column:
        y, m, d = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        ok = (y > 0) & (m.isNull() | m.between(1, 12)) & (d.isNull() | d.between(1, days))
        return F.when(ok, F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))

    return _let(v, lambda x: F.when(x.rlike(r"^\d{1,4}(?:-\d{1,2}){0,2}$"), _let(F.transform(F.split(x, "-"), lambda y: y.cast("int")), check)))


def _measure(c: Column, units: list[tuple[str, float]], low: float, high: float) -> Column:
    """Rounded number of the first unit that fits; c is in plain characters."""

    def number(v: Column) -> Column:
        out = F.lit(None).cast("double")
        for pattern, factor in reversed(units):
            out = F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1).try_cast("double") * factor).otherwise(out)
        return F.when(v.rlike(r"^\d"), out)

    return _let(_let(c, number), lambda x: F.when(x.between(low, high), F.round(x).cast("int").cast("string")))


def to_cm(c: Column) -> Column:
    v = F.lower(F.translate(c, _FROM, _TO))
    mixed = r"^(\d)(?:米|m)(\d{2})(?:厘米|公分|cm)?$"
    plain = lambda v: _measure(v, [(r"^(\d{2,3}(?:\.\d+)?)(?:cm|厘米|公分)?$", 1.0), (r"^(\d(?:\.\d+)?)(?:m|米|公尺)$", 100.0), (r"^(\d{3,4})(?:mm|毫米)$", 0.1)], 20, 300)
    return _let(v, lambda x: F.when(x.rlike(mixed), F.concat(F.regexp_extract(x, mixed, 1), F.regexp_extract(x, mixed, 2))).otherwise(plain(x)))


def to_kg(c: Column) -> Column:
    return _measure(F.lower(F.translate(c, _FROM, _TO)), [(r"^(\d+(?:\.\d+)?)(?:kg|kgs|千克|公斤)?$", 1.0), (r"^(\d+(?:\.\d+)?)(?:斤|市斤)$", 0.5), (r"^(\d+(?:\.\d+)?)(?:g|克)$", 0.001)], 1, 700)


CASTS = {"date": to_date_text, "cm": to_cm, "kg": to_kg, "text": lambda c: c}


def discover(df: DataFrame, attribute: str = "prop", value: str = "value") -> DataFrame:
    """The attribute list with the number of known values and the type that at least half of them cast to.

    Lengths are told from weights by their units; numbers without unit count for both.
    """
    v = known(F.col(value))
    rows = df.select(attribute_key(F.col(attribute)).alias("attr"), v.alias("v")).where("attr is not null and attr <> ''")
    got = rows.groupBy("attr").agg(
        F.count("v").alias("n"),
        *[F.count(CASTS[t](F.col("v"))).alias(f"n_{t}") for t in ("date", "cm", "kg")],
    )
    half = F.col("n") / 2
    kind = (
        F.when(F.col("n") == 0, "text")
        .when((F.col("n_date") >= half) & (F.col("n_date") >= F.greatest("n_cm", "n_kg")), "date")
        .when((F.col("n_cm") >= half) & (F.col("n_cm") >= F.col("n_kg")), "cm")
        .when(F.col("n_kg") >= half, "kg")
        .otherwise("text")
    )
    return got.withColumn("type", kind)


def _type_of(counts: list) -> str:
    """The type of several attributes together, by the rule of :func:`discover`."""
    n, date, cm, kg = (sum(r[c] for r in counts) for c in ("n", "n_date", "n_cm", "n_kg"))
    if not n:
        return "text"
    if 2 * date >= n and date >= max(cm, kg):
        return "date"
    if 2 * cm >= n and cm >= kg:
        return "cm"
    return "kg" if 2 * kg >= n else "text"


def report(df: DataFrame, columns: dict[str, tuple[str | None, list[str]]], attribute: str = "prop", value: str = "value") -> DataFrame:
    """Every attribute of the table as :func:`discover` finds it, with the column of ``columns`` it fills and that column's type.

    ``status``: 'mapped'; 'other type' if most known values don't cast to the column's type, so that they are lost;
    'unmapped' if no column takes the attribute; 'absent' for an attribute named that doesn't occur.
    """
    named = [(a, c, k) for c, (k, names) in columns.items() for a in names]
    wanted = df.sparkSession.createDataFrame(named, "attr string, column string, wanted string")
    fits = F.when(F.col("wanted").isNull(), F.col("n"))  # the type discovered is taken
    for k in CASTS:
        fits = F.when(F.col("wanted") == k, F.col("n") if k == "text" else F.col(f"n_{k}")).otherwise(fits)
    status = F.when(F.col("n").isNull(), "absent").when(F.col("column").isNull(), "unmapped").when(fits * 2 < F.col("n"), "other type").otherwise("mapped")
    return discover(df, attribute, value).join(F.broadcast(wanted), "attr", "full").select("attr", "n", "type", "column", "wanted", status.alias("status"))


def widen(df: DataFrame, columns: dict[str, tuple[str | None, list[str]]], entity: str = "name", attribute: str = "prop", value: str = "value", order: str = "row_id") -> DataFrame:
    """One row per entity with a column for each key of ``columns`` = {column: (type or None, attribute keys)}; None takes the type discovered.

    Attributes that ``columns`` doesn't name fill nothing; :func:`report` lists them. One named that doesn't occur
    gives a null column without costing an aggregation. The number of columns is the caller's, not the data's.
    """
    wanted = [a for _, (_, names) in columns.items() for a in names]
    found = {r["attr"]: r for r in discover(df.where(attribute_key(F.col(attribute)).isin(wanted)), attribute, value).collect()}
    name = clean(F.col(entity))
    rows = (
        df.select(name.alias("_e"), attribute_key(F.col(attribute)).alias("_a"), known(F.col(value)).alias("_v"), F.col(order).alias("_o"))
        .where(F.col("_e").isNotNull() & (F.col("_e") != "") & F.col("_a").isin(wanted) & F.col("_v").isNotNull())
    )
    to = {a: col for col, (_, names) in columns.items() for a in names if a in found}
    kind = {a: t or _type_of([found[x] for x in names if x in found]) for t, names in columns.values() for a in names if a in found}
    value_of = F.lit(None).cast("string")
    for k in dict.fromkeys(kind.values()):
        value_of = F.when(F.col("_a").isin([a for a in kind if kind[a] == k]), CASTS[k](F.col("_v"))).otherwise(value_of)
    slot = F.lit(None).cast("string")
    for col in dict.fromkeys(to.values()):
        slot = F.when(F.col("_a").isin([a for a in to if to[a] == col]), F.lit(col)).otherwise(slot)
    rows = rows.select("_e", slot.alias("_s"), F.struct(F.col("_o").alias("o"), value_of.alias("v")).alias("_x"))
    aggs = [F.min(F.when((F.col("_s") == c) & F.col("_x.v").isNotNull(), F.col("_x")))["v"].alias(c) if c in to.values() else F.max(F.lit(None).cast("string")).alias(c) for c in columns]
    return rows.groupBy(F.col("_e").alias(entity)).agg(*aggs)


def cells(wide: DataFrame, columns: list[str], entity: str = "name") -> DataFrame:
    """The filled cells of a wide table as (entity, attr, val)."""
    stack = ", ".join(f"'{c}', cast({c} as string)" for c in columns)
    return wide.selectExpr(f"`{entity}`", f"stack({len(columns)}, {stack}) as (attr, val)").where("val is not null")
