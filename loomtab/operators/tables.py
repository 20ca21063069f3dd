"""Algebra, features and classification of tables in long form.

A *cell relation* has one row per slot of a dense grid: table_id, row, col, content, tag, and optionally links
(text → address) and images. All operators keep the columns in ``KEYS`` that exist, take the keys of a table from
``keys`` and need at most one exchange by them, which the operators of a pipeline share. Tables are bounded; their number isn't.

Empty inputs give empty results; null contents count as empty text; the header row is row 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtab.config import COL, DEFAULT, ENTITY, INFO, OTHER, PROPERTY, ROW, TITLE, Config
from loomtab.functions.celltypes import cell_type, type_distance
from loomtab.functions.names import is_blank
from loomtab.functions.words import word_score

KEYS = ("table_id",)
TEXTUAL = ("中文", "英文", "大写", "小写", "大小写混合", "字符类型", "超链接", "其他类型", "标点类型")


def w(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys)


# ---- shape -----------------------------------------------------------------------------------------------------------
def expand_spans(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dense grid of anchored cells (row, col, rowspan, colspan); spans end with the table."""
    last = F.max("row").over(w(keys))
    rows = cells.withColumn("_last", last).withColumn("_rs", F.least(F.col("rowspan"), F.col("_last") - F.col("row") + 1))
    grid = rows.withColumn("_r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("_rs") - 1)))
    grid = grid.withColumn("_c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    return grid.withColumn("row", F.col("_r")).withColumn("col", F.col("_c")).drop("_r", "_c", "_rs", "_last")


def shapes(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_rows, n_cols, is_correct, is_normal): equal widths of all rows; at least two rows and columns."""
    per_row = cells.groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("width"), F.max("col").alias("last_col"))
    return per_row.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max("last_col") + 1).alias("n_cols"), (F.min("width") == F.max("width")).alias("is_correct")
    ).withColumn("is_normal", (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2))


def flip(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_r", F.col("row")).withColumn("row", F.col("col")).withColumn("col", F.col("_r")).drop("_r")


def drop_row(cells: DataFrame, i: int) -> DataFrame:
    return cells.where(F.col("row") != i).withColumn("row", F.when(F.col("row") > i, F.col("row") - 1).otherwise(F.col("row")))


def drop_col(cells: DataFrame, j: int) -> DataFrame:
    return cells.where(F.col("col") != j).withColumn("col", F.when(F.col("col") > j, F.col("col") - 1).otherwise(F.col("col")))


def row_at(cells: DataFrame, i: int) -> DataFrame:
    return cells.where(F.col("row") == i)


def col_at(cells: DataFrame, j: int) -> DataFrame:
    return cells.where(F.col("col") == j)


def stringify(cells: DataFrame) -> DataFrame:
    return cells.withColumn("content", F.coalesce(F.col("content").cast("string"), F.lit("")))


def typed(cells: DataFrame) -> DataFrame:
    images = F.size("images") > 0 if "images" in cells.columns else None
    return cells.withColumn("cell_type", cell_type(F.col("content"), images))


# ---- features --------------------------------------------------------------------------------------------------------
def _ratio(row: Column, col: Column) -> tuple[Column, Column]:
    total = row + col
    return F.when(total == 0, 0.0).otherwise(row / total), F.when(total == 0, 0.0).otherwise(col / total)


def spread_feature(cells: DataFrame, value: Column, keys: Sequence[str] = KEYS, name: str = "length") -> DataFrame:
    """Mean population deviation of a cell measure along rows and columns, as shares: (keys, row_<name>, col_<name>)."""
    v = cells.withColumn("_v", value.cast("double"))
    by_col = v.groupBy(*keys, "col").agg(F.stddev_pop("_v").alias("_s")).groupBy(*keys).agg(F.avg("_s").alias("_c"))
    by_row = v.groupBy(*keys, "row").agg(F.stddev_pop("_v").alias("_s")).groupBy(*keys).agg(F.avg("_s").alias("_r"))
    row, col = _ratio(F.col("_r"), F.col("_c"))
    return by_col.join(by_row, list(keys)).select(*keys, row.alias(f"row_{name}"), col.alias(f"col_{name}"))


def length_feature(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return spread_feature(cells, F.length(F.coalesce("content", F.lit(""))), keys)


def vector_distance(cells: DataFrame, i: int, j: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean type distance of rows i and j over the columns that both have."""
    t = typed(cells)
    a = t.where(F.col("row") == i).select(*keys, "col", F.col("cell_type").alias("_a"))
    b = t.where(F.col("row") == j).select(*keys, "col", F.col("cell_type").alias("_b"))
    return a.join(b, [*keys, "col"]).groupBy(*keys).agg(F.avg(type_distance(F.col("_a"), F.col("_b"))).alias("distance"))


def type_feature(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean type distance to the last row (col feature) and to the last column (row feature), as shares."""
    t = typed(cells).withColumn("_lr", F.max("row").over(w(keys))).withColumn("_lc", F.max("col").over(w(keys)))
    t = t.withColumn("_bottom", F.max(F.when(F.col("row") == F.col("_lr"), F.col("cell_type"))).over(w([*keys, "col"])))
    t = t.withColumn("_right", F.max(F.when(F.col("col") == F.col("_lc"), F.col("cell_type"))).over(w([*keys, "row"])))
    t = t.withColumn("_dc", type_distance(F.col("cell_type"), F.col("_bottom"))).withColumn("_dr", type_distance(F.col("cell_type"), F.col("_right")))
    col = t.where("row < _lr").groupBy(*keys, "row").agg(F.avg("_dc").alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("_c"))
    row = t.where("col < _lc").groupBy(*keys, "col").agg(F.avg("_dr").alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("_r"))
    a, b = _ratio(F.coalesce("_r", F.lit(0.0)), F.coalesce("_c", F.lit(0.0)))
    every = t.select(*keys).distinct()
    return every.join(col, list(keys), "left").join(row, list(keys), "left").select(*keys, a.alias("row_type"), b.alias("col_type"))


def word_feature(cells: DataFrame, keys: Sequence[str] = KEYS, score: Callable[[Column], Column] = word_score) -> DataFrame:
    return spread_feature(cells, score(F.col("content")), keys, "word")


def direction(cells: DataFrame, keys: Sequence[str] = KEYS, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, direction): header cells decide; otherwise the axis with the smaller mixed feature; if equal, by the word feature where a ``score`` is given; then ROW."""
    tags = cells.groupBy(*keys).agg(
        F.min(F.when(F.col("row") == 0, F.col("tag") == "th")).alias("_row_th"), F.min(F.when(F.col("col") == 0, F.col("tag") == "th")).alias("_col_th")
    )
    f = length_feature(cells, keys).join(type_feature(cells, keys), list(keys))
    row = F.round(0.5 * F.col("row_length") + 0.5 * F.col("row_type"), 12)
    col = F.round(0.5 * F.col("col_length") + 0.5 * F.col("col_type"), 12)
    made = F.when(F.col("_row_th"), ROW).when(F.col("_col_th"), COL).when(row > col, COL)
    if score is not None:
        f = f.join(word_feature(cells, keys, score), list(keys))
        made = made.when((row == col) & (F.round("row_word", 12) > F.round("col_word", 12)), COL)
    return tags.join(f, list(keys)).select(*keys, made.otherwise(ROW).alias("direction"))


# ---- headers and records ---------------------------------------------------------------------------------------------
def header_lines(cells: DataFrame, by: str = "tag", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lines): leading rows of header cells (by tag), or of textual cells (by type; 0 if all rows are)."""
    t = typed(cells)
    good = (F.col("tag") == "th") if by == "tag" else F.col("cell_type").isin(*TEXTUAL)
    per_row = t.groupBy(*keys, "row").agg(F.min(good).alias("_ok"))
    got = per_row.groupBy(*keys).agg(F.min(F.when(~F.col("_ok"), F.col("row"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
    every = F.col("_n") if by == "tag" else F.lit(0)
    return got.select(*keys, F.coalesce("_first", every).cast("long").alias("lines"))


def header_count(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, lines): 1, or with ``strict_header`` by tags, then by types, then 1."""
    if not config.strict_header:
        return cells.select(*keys).distinct().withColumn("lines", F.lit(1).cast("long"))
    tag = header_lines(cells, "tag", keys).withColumnRenamed("lines", "_t")
    kind = header_lines(cells, "type", keys).withColumnRenamed("lines", "_k")
    pick = F.when(F.col("_t").between(1, 2), F.col("_t")).when(F.col("_k") > 0, F.col("_k")).otherwise(F.lit(1))
    return tag.join(kind, list(keys)).select(*keys, pick.cast("long").alias("lines"))


def headers(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, col, header)."""
    return cells.where("row = 0").select(*keys, "col", F.coalesce("content", F.lit("")).alias("header"))


def header_lists(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return headers(cells, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "header"))), lambda x: x["header"]).alias("headers"))


def href_map(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, text, url): the first address of each link text of a table."""
    links = cells.select(*keys, "row", "col", F.explode("links").alias("text", "url"))
    return links.groupBy(*keys, "text").agg(F.min_by("url", F.struct("row", "col")).alias("url"))


def clean(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """Without serial columns, one-character last rows and rows of references; symbols only become empty text."""
    c = F.coalesce(F.col("content"), F.lit(""))
    serial = F.col("header").isin(*config.serial_headers)
    head = headers(cells, keys).where(serial).groupBy(*keys).agg(F.min("col").alias("_drop"))
    t = cells.join(head, list(keys), "left").where("_drop is null or col <> _drop")
    t = t.withColumn("col", F.when(F.col("col") > F.coalesce("_drop", F.lit(1 << 30)), F.col("col") - 1).otherwise(F.col("col"))).drop("_drop")
    for test in ((F.length(c) == 1) | is_blank(c), c.contains(config.references)):
        t = t.withColumn("_lr", F.max("row").over(w(keys))).withColumn("_all", F.min(test).over(w([*keys, "row"])))
        t = t.where("not (row = _lr and _all and row > 0)").drop("_lr", "_all")
    return t.withColumn("content", F.when(c.rlike(r"(?U)^\W*$"), "").otherwise(c))


def records(cells: DataFrame, keys: Sequence[str] = KEYS, skip_blank: bool = True) -> DataFrame:
    """(keys, row, prop, value) of every data row; of equal headers the last wins."""
    h = headers(cells, keys)
    body = cells.where("row > 0").select(*keys, "row", "col", F.coalesce("content", F.lit("")).alias("value"))
    joined = body.join(h, [*keys, "col"])
    got = joined.groupBy(*keys, "row", F.col("header").alias("prop")).agg(F.max_by("value", "col").alias("value"))
    return got.where(~is_blank(F.col("value"))) if skip_blank else got


def record_maps(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, record map) for JSON output."""
    return records(cells, keys).groupBy(*keys, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "value")))).alias("record"))


def to_json(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = record_maps(cells, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.to_json("record").alias("j")))), lambda x: x["j"]).alias("_r"))
    return rows.select(*keys, F.concat(F.lit("["), F.array_join("_r", ","), F.lit("]")).alias("json"))


def dump(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, dump): cells joined by commas, rows by line ends."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), ",")
    per_row = cells.groupBy(*keys, "row").agg(line.alias("_l"))
    return per_row.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_l"))), lambda x: x["_l"]), "\n").alias("dump"))


# ---- classification --------------------------------------------------------------------------------------------------
def _any_word(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for x in words:
        out = out | c.contains(x)
    return out


def _word_count(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(0)
    for x in words:
        out = out + F.when(c.contains(x), 1).otherwise(0)
    return out


def classify(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, is_info, is_property, is_title, is_entity, table_type); needs a ``caption`` column in ``cells``."""
    h = F.when(F.col("row") == 0, F.coalesce("content", F.lit("")))
    first = F.max(F.when((F.col("row") == 0) & (F.col("col") == 0), F.col("content")))
    agg = cells.groupBy(*keys).agg(
        first.alias("_first"), F.count(h).alias("_headers"), F.collect_set(h).alias("_set"),
        F.sum(_word_count(h, config.caption_words)).alias("_hits"), F.max(_any_word(h, config.relation_columns)).alias("_rel"),
        F.max(_any_word(h, config.person_columns)).alias("_person"), (F.max("row") + 1).alias("_rows"), F.max("caption").alias("caption"),
    )
    known = F.array(*[F.lit(x) for x in config.info_headers])
    share = F.when(F.size("_set") > 0, F.size(F.array_intersect("_set", known)) / F.size("_set")).otherwise(0.0)
    info = (F.col("_rows") == 2) & (F.coalesce(F.col("_first").isin(*config.info_names), F.lit(False)) | (share >= 0.5))
    prop = F.coalesce("_rel", F.lit(False)) | (F.coalesce("_hits", F.lit(0)) > F.col("_headers") / 2)
    title = _any_word(F.coalesce("caption", F.lit("")), config.caption_words)
    entity = F.coalesce("_person", F.lit(False))
    t = agg.select(*keys, info.alias("is_info"), prop.alias("is_property"), title.alias("is_title"), entity.alias("is_entity"))
    kind = F.when(F.col("is_info"), INFO).when(F.col("is_property"), PROPERTY).when(F.col("is_title"), TITLE).when(F.col("is_entity"), ENTITY).otherwise(OTHER)
    return t.withColumn("table_type", kind)


def relation_columns(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, col, header, priority): headers that hold a relation word, with the word's place in the list."""
    prio = F.coalesce(*[F.when(F.col("header").contains(x), F.lit(i)) for i, x in enumerate(config.relation_columns)])
    return headers(cells, keys).withColumn("priority", prio).where("priority is not null")


def person_column(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, person_col): the first header with a person word, or -1."""
    col = F.min(F.when((F.col("row") == 0) & _any_word(F.coalesce("content", F.lit("")), config.person_columns), F.col("col")))
    return cells.groupBy(*keys).agg(F.coalesce(col, F.lit(-1)).alias("person_col"))


def dictionary_union(cells: DataFrame, config: Config = DEFAULT, keys: Sequence[str] = KEYS) -> DataFrame:
    """(word): the headers of infoboxes joined to the known ones."""
    spark = cells.sparkSession
    info = classify(cells, config, keys).where("is_info").select(*keys)
    found = headers(cells, keys).join(info, list(keys), "left_semi").select(F.col("header").alias("word"))
    return found.unionByName(spark.createDataFrame([(x,) for x in config.info_headers], "word string")).distinct()
