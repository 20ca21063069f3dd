"""Matching entities across sources without keys: a deterministic cascade of exact joins.

Both sources become two narrow tables each: *names* (number, form, key) and *kin* (number, own name as it stands there,
class of the relation, name and number of the other person). A rule of the cascade is one exact join of the persons
left over in either source, on a 64-bit hash of (form of the name, name of a related person). A key that two left-over persons of
one source share tells nothing and is left out before the join, so that each side has a key once and a join can't
grow beyond its input, whatever is hot. A pair with enough keys in common is resolved if it is the only best one for
either side; resolved persons are anti-joined before the next rule. The rules go from whole names over aliases, names
without title, given names, initials and slips to clan names, and to the same with fewer related persons. A related person is also known by the name that a resolved
person has in the other source, which may resolve further persons, so that the rules are tried again as long as they resolve any and these
bring further names of related persons. At last come names that occur once in either source, first together with a remark in brackets (courtesy name, place,
dynasty) that is a fact of the person in the other source.

The confidence of a pair is the precision of its rule on labelled persons, smoothed by one right and one wrong case.
Labels may be given. Otherwise they come from :func:`structural_labels`, which doesn't look at the labelled persons'
names at all: if a pair of other persons is resolved, and each of the two has one numbered father (or mother) only, these
two parents are one person.

Hot persons: a person with a third of all statements has them spread by the hash of (name, related person); where rows are
joined on a person's number, persons with more than a thousandth of all rows are joined by broadcast (:mod:`~loomtab.operators.skew`).

Defined cases: null or blank names and addresses give no person; a person related to itself is ignored; repeated rows
count once; ties resolve nothing; empty tables give no pair; columns that aren't named are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.functions.script import RANGES, simplify, simplify_map
from loomtab.operators import nested
from loomtab.operators.skew import hot_keys, join_unique
from loomtab.session import cut, cut_counted

BRACKETS = r"[(（\[［【〔<〈].*?[)）\]］】〕>〉]"
TITLES = "(?:将军|先生|夫人|大人|娘娘|公|氏)$"
#: Relation words by class, and the class seen from the other side.
CLASSES = {
    "parent": ("父亲", "母亲", "养父", "养母"), "child": ("儿子", "女儿", "养子", "养女"), "spouse": ("妻子", "丈夫"), "teacher": ("师父",),
    "student": ("弟子", "门生"), "sibling": ("兄长", "弟弟", "姐姐", "妹妹"), "grandparent": ("祖父", "祖母"), "grandchild": ("孙子", "孙女"),
    "wife's parent": ("岳父", "岳母"), "daughter's spouse": ("女婿",), "friend": ("好友", "友人"), "colleague": ("同僚",), "enemy": ("政敌",), "cousin": ("堂兄", "堂弟"),
}
INVERSE = {"parent": "child", "child": "parent", "teacher": "student", "student": "teacher", "grandparent": "grandchild", "grandchild": "grandparent", "wife's parent": "daughter's spouse", "daughter's spouse": "wife's parent"}
ADDRESS = r"https?://[^\s'\"‘’“”|,，\[\]［］()（）]+"


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


_CLASS_OF = {w: k for k, ws in CLASSES.items() for w in ws}


def relation_class(word: Column, inverse: bool = False) -> Column:
    """The number of the class of a relation word; 0 for words of no class."""
    at = list(CLASSES).index
    d = {w: at(INVERSE.get(k, k) if inverse else k) + 1 for w, k in _CLASS_OF.items()}
    numbers = F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(numbers[F.regexp_replace(F.coalesce(word, F.lit("")), r"[^\p{L}]", "")], F.lit(0)).cast("byte")


_NUMBERS = [{w: list(CLASSES).index(INVERSE.get(k, k) if inverse else k) + 1 for w, k in _CLASS_OF.items()} for inverse in (False, True)]


def _word(word: str | None) -> str:
    """The letters of a relation word."""
    return "".join(filter(str.isalpha, word or ""))


def _classes(word: str | None) -> tuple[int, int, int]:
    """(number of the class, of the class from the other side, number of the word in :data:`SINGLE`): the same as :func:`relation_class` and :func:`_single`."""
    w = _word(word)
    return _NUMBERS[0].get(w, 0), _NUMBERS[1].get(w, 0), SINGLE.index(w) + 1 if w in SINGLE else 0


def name_key(name: Column) -> Column:
    """A name without remarks, white space, marks and case; words of a Latin name in order of the alphabet."""
    plain = F.lower(simplify(F.regexp_replace(F.coalesce(name, F.lit("")), BRACKETS, " ")))
    han = F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "")
    latin = F.array_join(F.array_sort(F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")), " ")
    return F.when(han.rlike("[a-z]"), latin).otherwise(han)


def number(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/(\d+)/?\s*$", 1).try_cast("long")


_LAST_NUMBER = re.compile(r"/([0-9]+)/?[ \t\n\x0b\f\r]*[\x85\u2028\u2029]?\Z")


def _number(url: str | None) -> int | None:
    """The same as :func:`number`."""
    m = _LAST_NUMBER.search(url or "")
    n = int(m[1]) if m and len(m[1].lstrip("0")) < 20 else None
    return n if n is not None and n < 1 << 63 else None


_BRACKETS, _ADDRESS, _NUMBER = re.compile(BRACKETS), re.compile(ADDRESS, re.IGNORECASE), re.compile(r"/(\d+)/?$")
_OUTER = re.compile(r"^\s*[\[(［]\s*(?=['\"‘’“”])|(?<=['\"‘’“”])\s*[\])］]\s*$")
_WORD = re.compile(r"[^\W_]+")
_LATIN = re.compile("[a-z]")
#: An endpoint in its plain form, with a name that holds neither quotation marks nor an address: name and number at once.
_PLAIN = re.compile(r"[\[(]'([^'\"‘’“”:]*)', '(?:(?i:https?)://[^\s'\"‘’“”|,，\[\]［］()（）]*/(\d{1,18})/?)?'[\])]")
_REMARK = re.compile("^字|人$")  # 字 with a courtesy name, X人 with a place or dynasty


def _whole_map(simple: dict[int, str]) -> dict[int, str]:
    """The same map with all common characters: one that a map lacks costs more to translate than one that stays as it is."""
    return {c: chr(c) for a, b in ((0x20, 0x24F), (0x3000, 0x303F), *RANGES, (0xFF00, 0xFFEF)) for c in range(a, b + 1)} | simple


def _plain_key(name: str | None, simple: dict[int, str]) -> str:
    """The same as :func:`name_key`."""
    plain = (name or "").translate(simple).lower()
    return plain if plain.isalnum() else _words_key(plain)


def _words_key(plain: str) -> str:
    words = _WORD.findall(_BRACKETS.sub(" ", plain))
    key = "".join(words)
    return " ".join(sorted(words)) if _LATIN.search(key) else key


def _remarks(name: str, simple: dict[int, str]) -> list[str]:
    """Remarks in brackets in a name."""
    found = _BRACKETS.findall(name)
    if not found:
        return found
    remarks = {_REMARK.sub("", "".join(_WORD.findall(x[1:-1].translate(simple).lower()))) for x in found}
    return sorted(x for x in remarks if x and not x.isdigit())


def endpoint(s: str | None, simple: dict[int, str]) -> tuple[str, int | None]:
    """(key of the name, number) of an endpoint text with name and address in either order and any quotation."""
    return _parsed(s, simple)[:2]


def _parsed(s: str | None, simple: dict[int, str]) -> tuple[str, int | None, list[str]]:
    """(key of the name, number, remarks in brackets) of an endpoint text."""
    s = s or ""
    if easy := _PLAIN.fullmatch(s):
        name, n = easy.groups()
        plain = name.translate(simple).lower()
        n = int(n) if n else None
        return (plain, n, []) if plain.isalnum() else (_words_key(plain), n, _remarks(name, simple))
    m = _ADDRESS.search(s)
    n = _NUMBER.search(m[0]) if m else None
    name = _OUTER.sub("", _ADDRESS.sub("", s))
    plain = _BRACKETS.sub(" ", name).translate(simple).lower()
    words = _WORD.findall(plain)
    key = "".join(words)
    if _LATIN.search(key):
        key = " ".join(sorted(words))
    return key, int(n[1]) if n and len(n[1]) < 19 else None, _remarks(name, simple)


def with_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with a column for the key of each name: ``names`` = {column of the name: column of its key}. In a batch each different name is worked on once."""
    simple = {ord(a): b for a, b in simplify_map(df.sparkSession).items()}
    schema = T.StructType([*df.schema.fields, *[T.StructField(k, T.StringType()) for k in names.values()]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole_map(simple)
        for b in it:
            cols = list(b.columns)
            for c in names:
                d = pc.dictionary_encode(b.column(b.schema.get_field_index(c)), null_encoding="encode")
                cols.append(pa.array([_plain_key(t, whole) for t in d.dictionary.to_numpy(zero_copy_only=False)], pa.string()).take(d.indices))
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *names.values()])

    return df.mapInArrow(run, schema)


def _endpoints(statements: DataFrame, c0: str, rel: str, c2: str) -> DataFrame:
    """(b, k, cls, word, who, no, m): each statement from either side, for a person b with the key of its name, the relation, the
    other person's key and number, and the remarks at its own name.

    In a batch each different text is parsed once, so that a hot person costs little.
    """
    simple = {ord(a): b for a, b in simplify_map(statements.sparkSession).items()}
    schema = pa.schema([("b", pa.int64()), ("k", pa.string()), ("cls", pa.int8()), ("word", pa.int8()), ("who", pa.string()), ("no", pa.int64()), ("m", pa.list_(pa.string()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole_map(simple)
        for b in it:
            n = b.num_rows
            texts = pc.dictionary_encode(pa.concat_arrays([b.column(0), b.column(2)]), null_encoding="encode")
            got = [_parsed(t, whole) for t in texts.dictionary.to_numpy(zero_copy_only=False)]
            key, no, m = (pa.array([g[j] for g in got], t) for j, t in enumerate((pa.string(), pa.int64(), schema.field("m").type)))
            at = texts.indices
            other = pa.concat_arrays([at.slice(n), at.slice(0, n)])
            words = pc.dictionary_encode(b.column(1), null_encoding="encode")
            forth, back, word = (pa.array(x, pa.int8()).take(words.indices) for x in zip(*map(_classes, words.dictionary.to_pylist()))) if n else [pa.array([], pa.int8())] * 3
            cols = [no.take(at), key.take(at), pa.concat_arrays([forth, back]), pa.concat_arrays([word, pa.repeat(pa.scalar(0, pa.int8()), n)]), key.take(other), no.take(other), m.take(at)]
            out = pa.RecordBatch.from_arrays(cols, schema=schema)
            yield out.filter(pc.is_valid(out.column(0)))

    return statements.select(F.col(c0), F.col(rel), F.col(c2)).mapInArrow(run, "b long, k string, cls byte, word byte, who string, no long, m array<string>")


def _forms(key: Column, kind: str) -> Column:
    """Forms of a full name as (form, key) structs; the form's letter starts the key."""
    latin = key.rlike("[a-z]")
    words = F.split(key, " ")
    surname = F.element_at(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), 1)

    def one(form: str, letter: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(form).alias("form"), F.concat(F.lit(letter), value).alias("key")))

    made = [one(kind, "F", key, key != "")]
    if kind == "full":
        made += [
            one("given", "G", F.substring(key, 2, 2), ~latin & (F.length(key) == 3)),
            one("clan", "S", F.substring(key, 1, 1), ~latin & (F.length(key) >= 2)),
            one("slip", "W", F.substring(key, 1, 2), ~latin & (F.length(key) == 3)),
            one("slip", "A", F.array_join(F.array_sort(F.split(F.replace(key, F.lit(" ")), "")), ""), latin),
            one("initial", "I", F.concat(F.substring(F.element_at(words, 1), 1, 1), F.element_at(words, 2)), latin & (F.size(words) == 2)),
            one("initial", "I", F.concat(F.substring(F.element_at(words, 2), 1, 1), F.element_at(words, 1)), latin & (F.size(words) == 2)),
        ]
    return F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))


def _other_forms(key: Column) -> Column:
    """Forms of a name as another source may write it."""
    latin = key.rlike("[a-z]")
    words = F.split(key, " ")
    bare = F.regexp_replace(key, TITLES, "")

    def one(form: str, letter: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(form).alias("form"), F.concat(F.lit(letter), value).alias("key")))

    made = [
        one("full", "F", key, key != ""),
        one("title", "F", bare, ~latin & (bare != key) & (F.length(bare) >= 2)),
        one("given", "G", key, ~latin & (F.length(key) == 2)),
        one("clan", "S", F.substring(key, 1, 1), key.rlike("^.氏$")),
        one("slip", "W", F.substring(key, 1, 2), ~latin & (F.length(key) == 3)),
        one("slip", "A", F.array_join(F.array_sort(F.split(F.replace(key, F.lit(" ")), "")), ""), latin),
        one("initial", "I", F.concat(F.element_at(words, 1), F.element_at(words, 2)), latin & (F.size(words) == 2) & (F.length(F.element_at(words, 1)) == 1)),
        one("initial", "I", F.concat(F.element_at(words, 2), F.element_at(words, 1)), latin & (F.size(words) == 2) & (F.length(F.element_at(words, 2)) == 1)),
    ]
    return F.array_distinct(F.filter(F.array(*made), lambda x: x.isNotNull()))


def _remarked(k: Column, remark: Column) -> Column:
    return F.concat(F.lit("R"), k, F.lit("\x01"), remark)


#: Relations in which a person has one other person only; the number of a word is its place from 1, 0 stands for all others.
SINGLE = ("父亲", "母亲")


def _plain_word(word: Column) -> Column:
    return F.regexp_replace(F.coalesce(word, F.lit("")), r"[^\p{L}]", "")


def _single(word: Column) -> Column:
    w = _plain_word(word)
    return reduce(lambda out, k: F.when(w == SINGLE[k], k + 1).otherwise(out), range(len(SINGLE)), F.lit(0)).cast("byte")


def _whole(key: Column) -> Column:
    """Hash of a whole name, as the names' keys of that form."""
    return F.xxhash64(F.concat(F.lit("F"), key))


ITEM, KIN, OWN, REMARK = 1, 2, 4, 8


def facts(df: DataFrame, kin: dict[str, str], own: str, remark: str) -> DataFrame:
    """(a, part, k, cls, word, value, no) of nested records (id, entity, relationship): what matching reads of them, in one pass.

    ``k``: key of the person's name. ``part`` adds up what a row is: the person itself (ITEM), a related person (KIN, ``value`` the key of the name,
    ``no`` the number), a name of its own (OWN) or a fact that may stand beside its name (REMARK, ``value`` the text). ``kin``: {pattern of the path: relation}.
    """
    simple = {ord(a): b for a, b in simplify_map(df.sparkSession).items()}
    schema = pa.schema([("a", pa.int64()), ("part", pa.int8()), ("k", pa.string()), ("cls", pa.int8()), ("word", pa.int8()), ("value", pa.string()), ("no", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(re.compile(p, re.ASCII), r) for p, r in kin.items()]
        own_, remark_ = re.compile(own, re.ASCII), re.compile(remark, re.ASCII)
        whole = _whole_map(simple)
        key, number_, classes = functools.lru_cache(1 << 12)(lambda t: _plain_key(t, whole)), functools.lru_cache(1 << 12)(_number), functools.lru_cache(1 << 12)(_classes)

        @functools.lru_cache(1 << 16)
        def part(path: str) -> tuple[int, tuple[int, int, int]]:
            rel = next((r for p, r in patterns if p.search(path)), None)
            return KIN * (rel is not None) + OWN * bool(own_.search(path)) + REMARK * bool(remark_.search(path)), classes(rel)

        def rows(texts: list[str | None], want: str) -> Iterator[tuple]:
            for got in nested.parse_fields(texts, want, lambda path: part(path)[0] > 0):
                for _, path, value, kind, name, url, to_name, to_url in got:
                    if (a := number_(url)) is None:
                        continue
                    if kind == "relation":
                        no, who, (cls, _, word) = number_(to_url), key(to_name), classes(value)
                        if who and no != a:
                            yield a, KIN, key(name), cls, word, who, no
                    elif kind == "item":
                        yield a, ITEM, key(name), 0, 0, None, None
                    elif kind == "string":
                        n, (cls, _, word) = part(path)
                        if n == KIN:
                            if who := key(value):
                                yield a, n, key(name), cls, word, who, None
                        else:
                            yield a, n, key(name), 0, 0, value, None

        for b in it:
            for at in range(0, b.num_rows, 256):  # bounds the index of very long fields
                x = b.slice(at, 256)
                found = [r for j, want in enumerate(("entity", "relationship")) for r in rows(x.column(j).to_pylist(), want)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return df.select("entity", "relationship").mapInArrow(run, "a long, part byte, k string, cls byte, word byte, value string, no long")


def source_a(persons: DataFrame, kin: DataFrame, aliases: DataFrame, remarks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """names(a, form, key, own) and kin(a, own, cls, word, who, no) of the source with attributes; keys and names as 64-bit hashes.

    ``persons``: a, name; ``kin``: a, rel, who, and perhaps name (the person's own, as it stands beside the relation)
    and no (the other person's number); ``aliases``: a, alias;
    ``remarks``: a, remark, facts that the other source puts in brackets beside a name. Of persons and kin whose keys are made already
    (:func:`facts`), the former have a, k and the latter a, own, cls, word, k, no.
    """
    keyed = lambda df, c, k: (df if c == k else with_keys(df.select("a", c).where("a is not null").distinct(), {c: k})).select("a", k).where(f"a is not null and {k} <> ''").distinct()
    full = keyed(persons, "k" if "k" in persons.columns else "name", "k")
    hashed = full.hint("shuffle_hash")  # here and below: the other side is the long one, and isn't sorted
    other = keyed(aliases, "alias", "k").join(hashed, ["a", "k"], "left_anti")
    # no row comes twice: keys of a person differ, and so do the forms of a key
    names = full.select("a", "k", F.inline(_forms(F.col("k"), "full"))).unionByName(other.select("a", "k", F.inline(_forms(F.col("k"), "alias"))))
    if remarks is not None:
        names = names.unionByName(hashed.join(keyed(remarks, "remark", "m"), "a").select("a", "k", F.lit("remark").alias("form"), _remarked(F.col("k"), F.col("m")).alias("key")))
    if "k" in kin.columns:
        related = kin.where("a is not null and (no is null or no <> a) and k <> ''")
    else:
        none = F.lit(None)
        kin = kin.select("a", (F.col("name") if "name" in kin.columns else none.cast("string")).alias("name"), relation_class(F.col("rel")).alias("cls"), _single(F.col("rel")).alias("word"), "who", (F.col("no") if "no" in kin.columns else none.cast("long")).alias("no"))
        related = with_keys(kin.where("a is not null and (no is null or no <> a)"), {"name": "own", "who": "k"}).where("k <> ''")
    related = related.select("a", F.when(F.col("own") != "", _whole(F.col("own"))).alias("own"), "cls", "word", "no", F.xxhash64("k").alias("who"))
    return names.select("a", "form", F.xxhash64("key").alias("key"), F.xxhash64("k").alias("own")), related


def source_b(statements: DataFrame, c0: str = "c0", rel: str = "c1", c2: str = "c2") -> tuple[DataFrame, DataFrame]:
    """names(b, form, key), which may repeat, and kin(b, own, cls, word, who, no) of the source of (endpoint, relation, endpoint) statements.

    Both come from one table of (person, name, relation, related person), written once without a shuffle.
    """
    both = _endpoints(statements, c0, rel, c2)
    both = cut(both.select("b", "k", F.when(F.col("k") != "", _whole(F.col("k"))).alias("own"), "cls", "word", F.when(F.col("who") != "", F.xxhash64("who")).alias("who"), "no", F.when(F.size("m") > 0, F.col("m")).alias("m")))
    remarked = F.transform(F.coalesce("m", F.array().cast("array<string>")), lambda x: F.struct(F.lit("remark").alias("form"), _remarked(F.col("k"), x).alias("key")))
    names = both.where("k <> ''").select("b", "k", "m").distinct().select("b", F.inline(F.concat(_other_forms(F.col("k")), remarked))).select("b", "form", F.xxhash64("key").alias("key"))
    related = both.where("who is not null and (no is null or no <> b)").select("b", "own", "cls", "word", "who", "no")
    return names, related


#: Rules in the order of the cascade: form of the name, least related persons in common, least of them with the same relation.
FIRST = [("full+2", "full", 2, 0), ("full+1 role", "full", 1, 1), ("full+1", "full", 1, 0)]
STRONG = [("alias+2", "alias", 2, 0), ("title+2", "title", 2, 0), ("given+2", "given", 2, 1), ("initial+2", "initial", 2, 0), ("slip+2", "slip", 2, 1), ("clan+3", "clan", 3, 2)]
WEAK = [*FIRST, ("alias+1", "alias", 1, 0), ("title+1", "title", 1, 0), ("given+1", "given", 1, 1), ("initial+1", "initial", 1, 0), ("slip+1", "slip", 1, 1), ("clan+2", "clan", 2, 2)]
ORDER = [r[0] for r in FIRST + STRONG + WEAK[len(FIRST) :]] + ["remark once", "full once", "alias once", "title once"]
#: Forms in either source that a rule's form joins.
SIDES = {"full": (["full"], ["full"]), "alias": (["alias"], ["full", "title"]), "title": (["full"], ["title"]), **{f: ([f], [f]) for f in ("given", "initial", "slip", "clan")}}


def _mask() -> Column:
    return F.bit_or(F.when(F.col("cls") > 0, F.call_function("shiftleft", F.lit(1), F.col("cls").cast("int"))).otherwise(0)).alias("m")


def _evidence(keys_a: DataFrame, keys_b: DataFrame, of: tuple[str, ...] = tuple(SIDES)) -> DataFrame:
    """(a, b, and for each form shared and roles): exact join of (form, h, a, cls) and (form, h, b, cls) on h, keys of several persons of one side left out."""

    def single(keys: DataFrame, side: str) -> DataFrame:
        one = keys.groupBy("form", "h").agg(F.min(side).alias(side), F.max(side).alias("_last"), _mask())
        return one.where(F.col(side) == F.col("_last")).select("form", "h", side, F.col("m").alias(f"m_{side}"))

    role = F.when(F.col("m_a").bitwiseAND(F.col("m_b")) != 0, 1).otherwise(0)
    met = single(keys_a, "a").hint("shuffle_hash").join(single(keys_b, "b"), ["form", "h"]).select("a", "b", "form", role.alias("role"))
    forms = [F.struct(F.sum(F.when(F.col("form") == list(SIDES).index(f), 1).otherwise(0)).alias("shared"), F.sum(F.when(F.col("form") == list(SIDES).index(f), F.col("role")).otherwise(0)).alias("roles")).alias(f) for f in of]
    return met.groupBy("a", "b").agg(*forms)


def _ruled(pairs: DataFrame, rules: list[tuple[str, str, int, int]]) -> DataFrame:
    """(a, b, rule, shared, roles): the pairs for which one of the rules holds, with the first of them."""
    won = F.lit(None)
    for name, form, least, roles in reversed(rules):
        x = F.col(form)
        won = F.when((x["shared"] >= least) & (x["roles"] >= roles), F.struct(F.lit(ORDER.index(name)).alias("rule"), x["shared"].alias("shared"), x["roles"].alias("roles"))).otherwise(won)
    return pairs.select("a", "b", won.alias("x")).where("x is not null").select("a", "b", "x.*")


def _resolve(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, rule, shared, roles) that are the only best one for either side: first rule, then most related persons."""
    score = F.struct((-F.col("rule")).alias("r"), "shared", "roles")
    for side in ("a", "b"):
        w = Window.partitionBy(side)
        pairs = pairs.withColumn(f"_x{side}", F.max(score).over(w)).withColumn(f"_n{side}", F.sum(F.when(score == F.col(f"_x{side}"), 1).otherwise(0)).over(w))
        pairs = pairs.withColumn(f"_ok{side}", (score == F.col(f"_x{side}")) & (F.col(f"_n{side}") == 1))
    return pairs.where("_oka and _okb").select("a", "b", "rule", "shared")


class _Done:
    """The pairs resolved so far, in tables by step."""

    def __init__(self):
        self.steps: list[DataFrame] = []

    def pairs(self, since: int = 0) -> DataFrame:
        return reduce(DataFrame.unionByName, self.steps[since:])

    def left(self, rows: DataFrame, *sides: str) -> DataFrame:
        """Rows of the persons that aren't resolved."""
        for side in sides:
            rows = rows.join(self.pairs().select(side), side, "left_anti")
        return rows

    def add(self, pairs: DataFrame) -> int:
        new, n = cut_counted(_resolve(pairs))
        self.steps.append(new)
        return n


def _row_keys(names: DataFrame, kin: DataFrame, side: str) -> DataFrame:
    """(h, number, cls) of whole names with related persons.

    The name is the one beside the relation, which takes no join; only the persons of several names are joined with all of theirs.
    """
    h = lambda own: F.xxhash64(own, "who").alias("h")
    here = kin.where("own is not null").select(h("own"), side, "cls")
    whole = names.where("form = 'full'").select(side, F.col("key").alias("k"))
    if "own" in names.columns:  # the source whose relations may be facts of a person without its name beside them
        bare = kin.where("own is null").select(side, "who", "cls").join(whole, side).select(h("k"), side, "cls")
        here = here.unionByName(bare)
    # few as a rule: written first, so that their size is known where the join with all relations is planned
    several = cut(whole.groupBy(side).agg(F.collect_set("k").alias("k")).where("size(k) > 1").select(side, F.explode("k").alias("k")))
    here = here.unionByName(several.join(kin.where("own is not null").select(side, "who", "cls"), side).select(h("k"), side, "cls"))
    return here.withColumn("form", F.lit(list(SIDES).index("full")).cast("byte"))


def _by_person(names: DataFrame, side: str) -> DataFrame:
    """(number, _names): the few names of a person with their forms, as the rules have them, in one row."""
    forms = F.array(*[F.when(F.col("form").isin(SIDES[f][side == "b"]), F.lit(k).cast("byte")) for k, f in enumerate(SIDES)])
    return names.select(side, "key", F.explode(F.array_compact(forms)).alias("form")).groupBy(side).agg(F.collect_set(F.struct("form", "key")).alias("_names"))


def _form_keys(rows: DataFrame, side: str) -> DataFrame:
    """(form, h, number, cls) of persons with their names and related persons."""
    return rows.select(side, "who", "cls", F.inline("_names")).select("form", F.xxhash64("key", "who").alias("h"), side, "cls")


def _once(names_a: DataFrame, names_b: DataFrame) -> DataFrame:
    """Pairs whose name, or name with a remark, occurs once in either source (among all persons, resolved or not)."""
    sides = {"remark once": (["remark"], ["remark"]), "full once": (["full"], ["full"]), "alias once": (["full", "alias"], ["full"]), "title once": (["full"], ["full", "title"])}

    def single(names: DataFrame, side: str, n: int) -> DataFrame:
        """(key, and for each rule the one person with the key, or null)."""
        of = {r: F.when(F.col("form").isin(forms[n]), F.col(side)) for r, forms in sides.items()}
        ends = [f(x).alias(f"{end}{k}") for k, x in enumerate(of.values()) for end, f in (("_first", F.min), ("_last", F.max))]
        got = names.where(F.col("form").isin(sorted({f for forms in sides.values() for f in forms[n]}))).groupBy("key").agg(*ends)
        return got.select("key", *[F.when(F.col(f"_first{k}") == F.col(f"_last{k}"), F.col(f"_first{k}")).alias(f"{side}{k}") for k in range(len(sides))])

    zero = F.lit(0).cast("long")
    pair = lambda k, r: F.when(F.col(f"a{k}").isNotNull() & F.col(f"b{k}").isNotNull(), F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"), F.lit(ORDER.index(r)).alias("rule")))
    met = single(names_a, "a", 0).join(single(names_b, "b", 1).hint("shuffle_hash"), "key").select(F.inline(F.array_compact(F.array(*[pair(k, r) for k, r in enumerate(sides)]))))
    return met.groupBy("a", "b").agg(F.min("rule").alias("rule")).select("a", "b", "rule", zero.alias("shared"), zero.alias("roles"))


def match(names_a: DataFrame, kin_a: DataFrame, names_b: DataFrame, kin_b: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(a, b, rule, shared, confidence). ``labels``: known pairs (a, b); none of their persons has another partner."""
    names_a, kin_a, names_b = (cut(t) for t in (names_a, kin_a, names_b))
    done = _Done()
    done.add(_ruled(_evidence(_row_keys(names_a, kin_a, "a"), _row_keys(names_b, kin_b, "b"), ("full",)), FIRST))
    hot = hot_keys({"a": kin_a.select("a"), "b": kin_b.select("b"), "no": kin_b.select("no")})
    own = cut(names_a.where("form = 'full'").groupBy("a").agg(F.collect_set("own").alias("_own")))
    # left over are persons without a pair; a form of theirs counts only if a left-over person of the other source has it, too
    left_a, left_b = done.left(names_a.where("form <> 'remark'"), "a"), done.left(names_b.where("form <> 'remark'"), "b")
    mine_a, mine_b = _by_person(left_a.join(left_b.select("key"), "key", "left_semi"), "a"), _by_person(left_b.join(left_a.select("key"), "key", "left_semi"), "b")
    keys_a = cut(_form_keys(join_unique(kin_a.select("a", "who", "cls"), mine_a, "a", hot["a"]), "a"))
    left = cut(join_unique(kin_b.select("b", "cls", "who", "no"), mine_b.hint("shuffle_hash"), "b", hot["b"]))

    keys_b, new = [], done.pairs()
    while True:
        # related persons under their own names at first, then also under those that persons resolved last have in the first source
        known = cut(new.select("a", F.col("b").alias("no")).join(own, "a").select("no", "_own"))  # few in later rounds, and then planned as such
        more = _form_keys(join_unique(left.where("no is not null").drop("who"), known if keys_b else known.hint("shuffle_hash"), "no", hot["no"]).withColumn("who", F.explode("_own")), "b")
        more, n = cut_counted((more if keys_b else more.unionByName(_form_keys(left, "b"))).join(keys_a.select("form", "h").hint("shuffle_hash"), ["form", "h"], "left_semi"))
        if not n:
            break
        rules = WEAK if keys_b else STRONG + WEAK
        keys_b.append(more)
        if not done.add(_ruled(_evidence(done.left(keys_a, "a"), done.left(reduce(DataFrame.unionByName, keys_b), "b")), rules)):
            break
        new = done.steps[-1]
    done.add(done.left(_once(names_a, names_b), "a", "b"))
    found = done.pairs()
    rated = confidence(found, labels if labels is not None else structural_labels(found, kin_a, kin_b))
    return found.join(F.broadcast(rated), "rule", "left").select("a", "b", F.element_at(F.array(*[F.lit(r) for r in ORDER]), F.col("rule") + 1).alias("rule"), "shared", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def structural_labels(found: DataFrame, kin_a: DataFrame, kin_b: DataFrame) -> DataFrame:
    """Pairs (a, b) of persons that are the one father, or mother, of two resolved persons, without regard to their names."""

    def parents(kin: DataFrame, side: str, out: str) -> DataFrame:
        one = kin.where("word > 0 and no is not null").groupBy(side, "word").agg(F.min("no").alias(out), F.max("no").alias("_last"))
        return one.where(F.col(out) == F.col("_last")).select(side, "word", out)

    of_a = parents(kin_a, "a", "pa").withColumnRenamed("word", "word_a")
    child = found.select("a", "b").join(of_a, "a").join(parents(kin_b, "b", "pb"), "b").where("word = word_a")
    pairs = child.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    for side in ("a", "b"):  # contradicting labels say nothing
        pairs = pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(side))).where("_n = 1").drop("_n")
    return pairs


def confidence(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Smoothed precision of each rule (one row per rule): (right + 1) / (judged + 2).

    A pair found is judged if a label names one of its persons: right if the label names the other one, too.
    """
    known = labels.select("a", "b").distinct()
    by_a, by_b = known.select("a", F.col("b").alias("_b")), known.select("b", F.col("a").alias("_a"))
    judged = found.join(by_a, "a", "left").join(by_b, "b", "left").where("_a is not null or _b is not null")
    right = (F.col("_b") == F.col("b")) | (F.col("_a") == F.col("a"))
    good = F.sum(F.when(right, 1).otherwise(0))
    return judged.groupBy("rule").agg(((good + 1) / (F.count(F.lit(1)) + 2)).alias("confidence"))
