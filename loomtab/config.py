"""Settings of the table and graph operators; everything may be overridden by the caller."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: words that mark columns, captions and infoboxes of person tables, in order of priority
    person_columns: tuple[str, ...] = ("人名", "姓名", "本名", "中文名", "英文名", "演员名", "人员", "者", "导演")
    # own default: headers of infoboxes; dictionary_union() adds those found in the data
    info_headers: tuple[str, ...] = ("中文名", "本名", "别名", "国籍", "民族", "出生地", "出生日期", "所处时代")
    relation_columns: tuple[str, ...] = ("关系", "称谓", "辈分", "亲属")
    caption_words: tuple[str, ...] = ("女", "兄", "弟", "妹", "友", "妻", "儿", "妃", "亲属", "家族")
    info_names: tuple[str, ...] = ("中文名", "本名")
    serial_headers: tuple[str, ...] = ("序号", "序")
    references: str = "参考资料"
    clan_suffix: str = "氏"
    longest_relation: int = 7
    longest_name: int = 7
    host: str = "https://baike.example.com"
    item_prefix: str = "/item/"
    infobox_class: str = "basic-info cmn-clearfix"
    unnamed: str = "未命名表格"
    relevance: float = 0.8
    drop_tags: tuple[str, ...] = ("script", "style", "code")
    list_tables: bool = True
    strict_header: bool = False
    header_relation: bool = False
    queue_limit: int = 1_000_000
    recent: int = 200


DEFAULT = Config()
INFO, PROPERTY, TITLE, ENTITY, OTHER = "个人信息表", "属性关系表", "标题关系表", "实体关系表", "其他表"
ROW, COL = "ROW", "COL"
