"""Types of table cells and the distance between two types in their tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"^(?:https?|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]+[-A-Za-z0-9+&@#/%=~_|]"
HAN = "一-龥"  # the basic block up to U+9FA5

#: Each type with its parent.
PARENT = {
    "类型": None, "超链接": "类型", "图片": "类型", "字符和数字": "类型", "其他类型": "类型", "标点类型": "类型",
    "字符类型": "字符和数字", "数字类型": "字符和数字", "中文": "字符类型", "英文": "字符类型",
    "<=0": "数字类型", "0-1": "数字类型", ">=1": "数字类型", "大写": "英文", "小写": "英文", "大小写混合": "英文",
}


def ancestors(t: str) -> list[str]:
    out = [t]
    while PARENT[out[-1]] is not None:
        out.append(PARENT[out[-1]])
    return out


def depth(t: str) -> int:
    return len(ancestors(t)) - 1


def tree_distance(a: str, b: str) -> int:
    """Edges on the path between two types."""
    up = ancestors(a)
    for steps, t in enumerate(ancestors(b)):
        if t in up:
            return steps + up.index(t)
    raise ValueError((a, b))


def cell_type(content: Column, has_images: Column | None = None) -> Column:
    s = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+|\s+$", "")
    plain = F.when(~s.rlike(f"^[{HAN}A-Za-z0-9]+$"), "其他类型")
    number = F.when(s.rlike("^0+$"), "<=0").when(s.rlike("^[1-9][0-9]*$"), ">=1").otherwise("数字类型")
    letters = F.when(s.rlike("^[A-Z]+$"), "大写").when(s.rlike("^[a-z]+$"), "小写").otherwise("大小写混合")
    made = (
        F.when(s.rlike(LINK), "超链接")
        .when(s.rlike(r"(?U)^\W*$"), "标点类型")
        .when(plain.isNotNull(), plain)
        .when(s.rlike(f"^[0-9]+[{HAN}]?$"), number)
        .when(s.rlike(f"^[{HAN}]+$"), "中文")
        .when(s.rlike("^[A-Za-z]+$"), letters)
        .otherwise("字符类型")
    )
    return made if has_images is None else F.when(has_images, "图片").otherwise(made)


def type_depth(t: Column) -> Column:
    return F.create_map(*[F.lit(x) for k in PARENT for x in (k, depth(k))])[t]


def type_distance(a: Column, b: Column) -> Column:
    """By a literal table of all pairs of types (a few hundred bytes in the plan, no join)."""
    table = F.create_map(*[F.lit(x) for p in PARENT for q in PARENT for x in (f"{p}|{q}", tree_distance(p, q))])
    return table[F.concat_ws("|", a, b)]
