"""Operators for training data: brute force, round trips, hot keys and odd inputs."""

import collections
import json
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtab.functions.urls import page_key
from loomtab.llm import collapse, leakage, mainbody, matching, packing, queries, seen, tokens, topics
from loomtab.operators import skew

rnd = random.Random(5)


# ---- seen before -----------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**20 - 1), max_size=200), st.sets(st.integers(0, 2**20 - 1), max_size=50))
def test_elias_fano(values, probes):
    v = np.array(sorted(values), np.uint64)
    ef = seen.EliasFano(v, 20)
    assert (ef.values() == v).all()
    x = np.array(sorted(probes | set(list(values)[:9])), np.uint64)
    assert ef.contains(x).tolist() == [int(p) in values for p in x]
    assert ef.successor(x).tolist() == np.searchsorted(v, x).tolist()
    again = seen.EliasFano.load(20, *ef.dump())
    assert (again.merge(x).values() == np.union1d(v, x)).all()


def test_elias_fano_is_small():
    v = np.unique(np.random.default_rng(1).integers(0, 2**60, 20_000, np.uint64))
    ef = seen.EliasFano(v, 60)
    assert (len(ef.low) * 8 + len(ef.high)) * 8 / len(v) < 60 - np.log2(len(v)) + 4


def brute_seen(pending, earlier):
    old = {k for _, k in earlier if k is not None}
    first = {}
    for i, k in pending:
        if k is not None:
            first[k] = min(first.get(k, i), i)
    return {i for i, k in pending if k is not None and (k in old or first[k] < i)}


@pytest.mark.parametrize("hot", [False, True])
def test_seen_before(spark, hot):
    key = lambda: None if rnd.random() < 0.05 else "hot" if hot and rnd.random() < 0.4 else str(rnd.randrange(300))
    pending = [(i * 3, key()) for i in range(800)] + [(3, "x"), (3, "x")]
    earlier = [(i, key()) for i in range(100)]
    p, e = (spark.createDataFrame(x, "id long, k string").withColumn("h", F.lit(1)).withColumn("part", F.lit("?")) for x in (pending, earlier))
    got = seen.seen_before(p.repartition(5), e, F.col("k"), rows_a_part=50)
    assert {r["id"] for r in got.collect()} == brute_seen(pending, earlier)
    assert {r["id"] for r in seen.seen_before(p, e.limit(0), F.col("k")).collect()} == brute_seen(pending, [])
    assert seen.seen_before(p.limit(0), e, F.col("k")).count() == 0
    report = seen.error_report(got, p, e, F.col("k")).first()
    assert report["wrong_answers"] == 0 and report["expected_rate"] < 1e-12


def test_store_merges(spark):
    a, b = (spark.createDataFrame([(str(i),) for i in r], "k string") for r in (range(50), range(40, 90)))
    s = seen.merge_store(seen.build_store(a, F.col("k"), 2), b, F.col("k"), 2)
    assert s.agg(F.sum("n")).first()[0] == 90


# ---- collapse --------------------------------------------------------------------------------------------------------
def statement():
    return queries._statement()


def test_formatting(spark):
    same = [("['甲·乙', 'https://x/1']", "父亲"), ("('甲 乙','https://x/1')", "父 亲："), ("['HTTPS://X/1', '甲乙']", "「父亲」"), ("［‘甲乙’，‘https://x/1’］", " 父亲\t")]
    other = [("['甲乙', '']", "父亲"), ("['甲乙', 'https://x/2']", "父亲"), ("['甲乙', 'https://x/1']", "父"), ("['甲乙', 'https://x/1']", None), ("['甲乙', 'https://x/1']", "")]
    rows = [(i, a, b, "['丙', '']") for i, (a, b) in enumerate(same + other)] + [(20, None, None, None), (21, "", "", "")]
    df = spark.createDataFrame(rows, "row_id long, c0 string, c1 string, c2 string").withColumn("key", F.lit(1)).withColumn("h", F.lit(2))
    got = {tuple(r) for r in collapse.copies(df, statement(), "row_id").collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (7, 8), (20, 21)}
    counts = {r["keep_id"]: r["copies"] for r in collapse.collapse(df, statement(), "row_id").collect()}
    assert counts == {0: 4, 4: 1, 5: 1, 6: 1, 7: 2, 20: 2}
    assert collapse.copies(df.limit(0), statement(), "row_id").count() == 0


@pytest.mark.parametrize("max_bits", [1 << 13, 1 << 27])
def test_collapse_against_brute_force(spark, max_bits):
    rows = [(i, "hot" if rnd.random() < 0.34 else str(rnd.randrange(4000))) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id long, k string").repartition(6)
    groups = collections.defaultdict(list)
    for i, k in rows:
        groups[k].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    got = [tuple(r) for r in collapse.copies(df, F.col("k"), "row_id", max_bits=max_bits).collect()]
    assert len(got) == len(want) and set(got) == want
    one = {r["keep_id"]: r["copies"] for r in collapse.collapse(df, F.col("k"), "row_id", max_bits=max_bits).collect()}
    assert one == {min(g): len(g) for g in groups.values()}


def test_filters_miss_no_repeat():
    h = np.random.default_rng(3).integers(0, 2**63, 3000).astype(np.uint64)
    parts = [h[:1500], h[1000:2200], h[2100:]]
    twos = []
    for p in parts:
        t = collapse.TwoFilters(1 << 16)
        t.add(p)
        twos.append(t)
    once, again = twos[0].once.copy(), twos[0].again.copy()
    for t in twos[1:]:
        again |= t.again | (once & t.once)
        once |= t.once
    assert collapse._test(again, collapse._positions(np.concatenate((h[1000:1500], h[2100:2200])), 1 << 16)).all()


# ---- leakage ---------------------------------------------------------------------------------------------------------
WORDS = [chr(0x4E00 + i) for i in range(3000)]


def passage(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) for _ in range(n))


def test_leaks(spark):
    items = [(1, "判断下面的说法：" + passage(120, 1)), (2, "判断下面的说法：" + passage(120, 2)), (3, "判断下面的说法：" + passage(90, 3)), (4, None), (5, "short one")]
    p = passage(120, 1)
    docs = [
        (1, "前" * 30 + p + "后" * 30), (2, "，\n".join(p[i : i + 15] for i in range(0, 120, 15))), (3, p[60:] + passage(20, 9) + p[:60]), (4, passage(300, 77) + p[:20]), (5, "判断下面的说法："), (6, None), (7, ""), (8, p[40:90]),
        (9, "".join("错" if i % 24 == 23 else c for i, c in enumerate(p))), (10, passage(200000, 8) + passage(120, 2)), (11, p), (12, p),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("share", F.lit(0)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, i).collect()}
    assert got == {(1, x) for x in (1, 2, 3, 8, 9, 11, 12)} | {(2, 10)}
    assert {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, i, block=2).collect()} >= {(1, 1), (2, 10)}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0
    clean = {r["doc_id"]: r["text"] for r in leakage.remove_spans(d, leakage.leaked_spans(d, i)).collect()}
    assert clean[1] == "前" * 30 + "后" * 30 and clean[11] == "" and clean[4] == docs[3][1] and clean[6] is None


def test_leaks_with_many_changed_words(spark):
    p, q = passage(120, 31), passage(60, 32)
    form = lambda r: f"若论{passage(2, r)}，勤勉的{passage(3, r + 1)}未必居首；若论{passage(2, r + 2)}，则同时无人能及。"
    items = [(1, p), (2, form(40) + q[:34])]
    docs = [(k, "前" * 20 + "".join("错" if i % k == k - 1 else c for i, c in enumerate(p)) + "后" * 20) for k in (7, 9, 10)] + [(20, passage(99, 33) + form(50) + passage(99, 34)), (21, q[:34])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["item_id"], r["doc_id"]) for r in leakage.leaks(d, i).collect()} == {(1, 7), (1, 9), (1, 10), (2, 21)}
    clean = {r["doc_id"]: r["text"] for r in leakage.remove_spans(d, leakage.leaked_spans(d, i)).collect()}
    assert all(len(clean[k]) < 45 and clean[k].startswith("前" * 20) for k in (7, 9, 10)) and clean[20] == docs[3][1]


def test_token_hashes_ignore_layout():
    table = tokens.char_table({"國": "国"})
    t = tokens.Tokens(["Ab-c１ 中國，x", "AB\tC1　中国 X", "", None, "abc1中国x"], table)
    a, b, c = (t.hash[t.text == k].tolist() for k in (0, 1, 4))
    assert a == b and a != c and len(a) == 5
    assert [t.start[0], t.end[0]] == [0, 2]


def test_instructions():
    got = leakage.without_instructions(["Read. A b c.", "read. D e.", "Read. F.", "Lone: x"])
    assert got == [" A b c.", " D e.", " F.", "Lone: x"]


# ---- main body -------------------------------------------------------------------------------------------------------
BODY = "".join(f"<p>第{i}年，传主往来各处，一面研习，一面著书。</p>" for i in range(5))
PAGE = (
    '<html><head><title>甲_站</title><style>p{}</style></head><body><div class="menu"><ul>' + '<li><a href="/a">首页</a></li>' * 5 + f"</ul></div><div><h1>甲</h1><dl><dt>别名</dt><dd>乙</dd></dl><h2>生平</h2>{BODY}"
    '<div class="x">扫码领取会员</div><table><tr><td><a href="/b">丙</a></td><td>友</td></tr></table></div><aside><h3>热门</h3><ul>' + '<li><a href="/c">丁</a></li>' * 6
    + '</ul><p><a href="/d">戊</a>：戊为人宽厚，家中兄弟三人。</p></aside><div><h3>留言</h3><p>书友12：写得好，收藏了。</p></div><footer><p>版权所有</p></footer></body></html>'
)


def test_main_body():
    import html

    want = ["甲", "别名", "乙", "生平", *[f"第{i}年，传主往来各处，一面研习，一面著书。" for i in range(5)], "丙", "友"]
    for s in (PAGE, html.escape(PAGE), html.escape(html.escape(PAGE)), PAGE.replace("</p>", "").replace("</li>", "").replace("</td>", "")):
        assert mainbody.main_blocks(s) == want
    for s in (None, "", "  ", "<", "no markup", "<div>" * 3000 + "x", PAGE[:200]):
        mainbody.main_blocks(s)


def test_main_body_in_deep_nesting():
    want = mainbody.main_blocks(PAGE)
    for depth in (390, 500, 5000):
        assert mainbody.main_blocks(PAGE.replace("<body>", "<body>" + "<div>" * depth)) == want


def test_unescaping_looks_at_the_whole_page():
    import html

    plain = "前言" * 1500 + "<p>&lt;p&gt;</p>"
    assert mainbody.unescape_at_rest(plain) == plain
    s = PAGE
    for _ in range(7):
        s = html.escape(s)
    assert mainbody.unescape_at_rest(s) == PAGE and mainbody.unescape_at_rest("1 &lt; 2") == "1 < 2"


def test_main_body_rows(spark):
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None), (3, "")], "id long, html string").withColumn("text", F.lit(1))
    assert mainbody.blocks(df).groupBy("id").count().collect()[0]["count"] == 22


# ---- packing ---------------------------------------------------------------------------------------------------------
def test_best_fit():
    r = np.random.default_rng(2)
    size = r.integers(1, 400, 3000)
    for source, cluster in ((r.integers(0, 40, 3000), np.where(r.random(3000) < 0.1, 1, np.arange(3000))), (np.where(r.random(3000) < 0.33, 0, r.integers(1, 40, 3000)), np.arange(3000))):
        b = packing.best_fit(size, source, cluster, 1000)
        used, least = np.bincount(b, size), -(-size.sum() // 1000)
        assert used.max() <= 1000 and len(used) <= least * 1.03 + 1
        for group in (source, cluster):  # a conflict only where counting proves it
            n = collections.Counter(group.tolist())
            assert all(k <= -(-n[g] // least) for (g, _), k in collections.Counter(zip(group.tolist(), b.tolist())).items())
    alone = packing.best_fit(np.array([5, 5, 5]), np.array([1, 2, 3]), np.array([7, 7, 8]), 100)
    assert len(set(alone.tolist())) == 1  # room goes before conflicts
    apart = packing.best_fit(np.full(20, 50), np.arange(20), np.repeat(np.arange(10), 2), 100)
    assert all(apart[2 * i] != apart[2 * i + 1] for i in range(9))


def test_pack(spark):
    rows = [(1, 25, 0, 1), (2, 10, 0, 2), (3, 0, 0, 3), (4, 5, 1, 4), (4, 5, 1, 4), (5, 10, 1, 5)]
    m = spark.createDataFrame(rows, "doc_id long, tokens long, source long, cluster long")
    got = packing.pack(m, capacity=10).collect()
    per = collections.Counter()
    for r in got:
        per[r["container"]] += r["tokens"]
    assert max(per.values()) <= 10 and len(per) == 6
    assert sorted((r["doc_id"], r["tokens"]) for r in got) == [(1, 5), (1, 10), (1, 10), (2, 10), (4, 5), (4, 5), (5, 10)]
    assert packing.pack(m.limit(0)).count() == 0


def test_measure(spark):
    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no tokenizer files")
    text = "中文 text 123"
    df = spark.createDataFrame([(1, text, "s"), (2, text + "\n", None), (3, None, "s"), (4, "", "s")], "doc_id long, text string, source string").withColumn("tokens", F.lit("x"))
    got = {r["doc_id"]: r for r in packing.measure(df).collect()}
    enc = packing.encoding(packing.TOKENIZER)
    assert set(got) == {1, 2, 4} and got[1]["tokens"] == len(enc.encode_ordinary(text)) and got[4]["tokens"] == 0
    assert got[1]["cluster"] == got[2]["cluster"] and enc.decode(enc.encode_ordinary(text)) == text


# ---- matching --------------------------------------------------------------------------------------------------------
def test_endpoints():
    simple = {ord("國"): "国"}
    for s in ("['甲 國（字子）', 'https://x/item/%E7/12']", '["https://x/item/%E7/12","甲·国"]', "［‘甲国’，‘https://x/item/%E7/12’］", "甲国 | https://x/item/%E7/12", " ('甲国[岚]', 'https://x/item/%E7/12')\n"):
        assert matching.endpoint(s, simple) == ("甲国", 12)
    assert matching.endpoint("['B. Ab', '']", {}) == ("ab b", None) and matching.endpoint(None, {}) == ("", None)


def test_endpoints_with_addresses_in_capitals():
    for s in ("['甲', 'HTTPS://RENWU.EXAMPLE.ORG/ITEM/%E7/12']", "['Https://Renwu.example.org/item/%E7/12', '甲']"):
        assert matching.endpoint(s, {}) == ("甲", 12)


def _sources(spark):
    persons = [(1, "赵匡胤"), (2, "赵普"), (3, "钱俶 "), (4, "孙一二"), (5, "孙一二"), (6, "周七八"), (7, None)]
    kin = [(1, "父亲", "赵弘殷"), (1, "友人", "赵普"), (2, "友人", "赵匡胤"), (3, "妻子", "孙太真"), (3, "同僚", "李煜"), (4, "父亲", "孙大"), (4, "师父", "吴六"), (5, "父亲", "孙小"), (5, "师父", "郑五"), (6, "父亲", "周大"), (6, "好友", "吴六")]
    alias = [(1, "香孩儿"), (3, "文德先生")]
    a = matching.source_a(*(spark.createDataFrame(r, s) for r, s in ((persons, "a long, name string"), (kin, "a long, rel string, who string"), (alias, "a long, alias string"))))
    e = lambda n, i: f"['{n}', '{'https://x/item/' + n + '/' + str(i) if i else ''}']"
    rows = [
        (e("香孩儿", 101), "父亲", e("赵弘殷", 0)), (e("香孩儿", 101), "友人", e("趙普", 102)), (e("钱俶", 103), "妻子", e("孙太真", 0)), (e("孙一二", 104), "父亲", e("孙大", 0)), (e("孙一二", 104), "师父", e("吴六", 0)),
        (e("孙一二", 105), "父亲", e("孙小", 0)), (e("周七八", 106), "父亲", e("周大", 0)), (e("周七八", 106), "好友", e("吴六", 0)), (e("周七八", 106), "好友", e("吴六", 0)), (None, None, None), ("", "", ""),
    ]
    b = matching.source_b(spark.createDataFrame(rows, "c0 string, c1 string, c2 string").withColumn("b", F.lit(1)))
    return a, b


def test_matching(spark):
    (na, ka), (nb, kb) = _sources(spark)
    got = {(r["a"], r["b"]): r for r in matching.match(na, ka, nb, kb).collect()}
    assert set(got) == {(1, 101), (2, 102), (3, 103), (4, 104), (5, 105), (6, 106)}
    assert all(0 < r["confidence"] < 1 for r in got.values())
    assert matching.match(na.limit(0), ka.limit(0), nb, kb).count() == 0
    labels = spark.createDataFrame([(4, 104), (5, 105)], "a long, b long")
    rated = {r["rule"]: r["confidence"] for r in matching.match(na, ka, nb, kb, labels).collect()}
    assert rated["full+2"] > 0.5


def test_remarks_tell_namesakes_apart(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    persons, facts = make([(1, "孙一二"), (2, "孙一二"), (3, "周七")], "a long, name string"), make([(1, "岚州"), (2, "楮州"), (2, "东汐"), (3, "岚州")], "a long, remark string")
    e = lambda n, i: f"['{n}', 'https://x/item/{i}']"
    rows = [(e("孙一二（岚州人）", 11), "友人", e("孙一二[东汐]", 12)), (e("孙一二", 12), "友人", e("孙一二（大棠人）", 13))]
    na, ka = matching.source_a(persons, make([], "a long, rel string, who string"), make([], "a long, alias string"), facts)
    nb, kb = matching.source_b(make(rows, "c0 string, c1 string, c2 string"))
    assert {(r["a"], r["b"], r["rule"]) for r in matching.match(na, ka, nb, kb).collect()} == {(1, 11, "remark once"), (2, 12, "remark once")}


def test_matching_with_a_hot_person(spark):
    """A person with a third of all statements, and persons known by weaker forms of their names."""
    n = 60
    name = lambda i: chr(0x4E00 + i) + chr(0x5000 + 3 * i) + chr(0x6000 + 7 * i)
    persons = [(i, name(i)) for i in range(n)] + [(900, "霍热人")]
    kin = [(i, "父亲", name((i + 7) % n)) for i in range(n)] + [(i, "好友", name((i + 11) % n)) for i in range(n)] + [(900, "弟子", name(i)) for i in range(n)]
    alias = [(i, f"号{chr(0x7000 + 5 * i)}{chr(0x7800 + i)}") for i in range(n)]
    a = matching.source_a(*(spark.createDataFrame(r, s) for r, s in ((persons, "a long, name string"), (kin, "a long, rel string, who string"), (alias, "a long, alias string"))))
    seen_as = lambda i: alias[i][1] if i % 5 == 0 else name(i)
    e = lambda x, i: f"['{x}', 'https://x/item/{i}']"
    of = lambda i: e(seen_as(i % n), 1000 + i % n)
    rows = [(of(i), "父亲", of(i + 7)) for i in range(n)] + [(of(i), "好友", of(i + 11)) for i in range(n)] + [(e("霍热人", 1900), "弟子", of(i)) for i in range(n)]
    b = matching.source_b(spark.createDataFrame(rows, "c0 string, c1 string, c2 string"))
    got = {(r["a"], r["b"]): r for r in matching.match(*a, *b).collect()}
    assert set(got) == {(i, 1000 + i) for i in range(n)} | {(900, 1900)}
    assert {got[i, 1000 + i]["rule"] for i in range(0, n, 5)} <= {"alias+2", "alias+1", "alias once"}


def test_confidence_is_smoothed_precision(spark):
    found = spark.createDataFrame([(1, 11, 0), (2, 12, 0), (3, 13, 0), (4, 14, 1), (5, 15, 1)], "a long, b long, rule int")
    labels = spark.createDataFrame([(1, 11), (2, 12), (3, 99), (9, 14)], "a long, b long")
    got = {r["rule"]: r["confidence"] for r in matching.confidence(found, labels).collect()}
    assert got == {0: (2 + 1) / (3 + 2), 1: (0 + 1) / (1 + 2)}


def _shuffled(spark, run):
    """Rows that the jobs of ``run()`` write for shuffles."""
    sc, group = spark.sparkContext, f"shuffled-{rnd.random()}"
    sc.setJobGroup(group, "")
    try:
        run()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for j in sc.statusTracker().getJobIdsForGroup(group) for k in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteRecords() for k in stages)


def test_hot_keys_send_counts_of_buckets(spark):
    rows = spark.range(200_000, numPartitions=2).select(F.when(F.col("id") % 5 == 0, 7).otherwise(F.col("id")).alias("k"))
    got = {}
    sent = _shuffled(spark, lambda: got.update(skew.hot_keys({"k": rows, "l": rows.where("k <> 7")})))
    assert got == {"k": [7], "l": []} and sent < 50_000


def test_few_persons_of_several_names_move_no_relations(spark):
    n = 20_000
    kin = spark.range(n).selectExpr("id % 1000 as b", "id % 1000 as own", "cast(1 as byte) as cls", "id as who")
    names = spark.range(1000).selectExpr("id as b", "'full' as form", "id as key").unionByName(spark.createDataFrame([(3, "full", 5000)], "b long, form string, key long"))
    got, threshold = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "10k")  # all names are beyond it
    try:
        sent = _shuffled(spark, lambda: got.extend(matching._row_keys(names, kin, "b").collect()))
    finally:
        spark.conf.unset(threshold)
    assert len(got) == n + 2 * (n // 1000) and sent < n // 2


def test_facts(spark):
    """Records read in one pass give the persons, relations and texts that the general way gives."""
    url = "https://x/item/%E7/"
    item = lambda name, no, facts: [[name, url + no if no else ""], facts]
    entity = json.dumps([item("赵 匡胤（太祖）", "1", {"父亲": "赵弘殷", "字号": ["元朗", 7], "任职经历": [{"同僚": [{"姓名": "赵普"}]}], "父": "否"}), item("无", "", {"别名": "某"}), item("B. Ab", "2", {})], ensure_ascii=False)
    relationship = json.dumps([[["赵匡胤", url + "1"], " 父亲：", ["赵弘殷", url + "9"]], [["赵匡胤", url + "1"], "友人", ["赵匡胤", url + "1"]], [["B. Ab", url + "2"], None, ["赵普", ""]]], ensure_ascii=False)
    df = spark.createDataFrame([(1, entity, relationship), (2, None, ""), (3, "[[", "{")], "id long, entity string, relationship string")
    got = [tuple(r) for r in matching.facts(df, {r"^父亲\Z": "父亲", queries.COMPANIONS: "同僚"}, queries.OWN_NAMES, queries.REMARKS).collect()]
    parent, colleague = list(matching.CLASSES).index("parent") + 1, list(matching.CLASSES).index("colleague") + 1
    item_, kin, text = matching.ITEM, matching.KIN, matching.OWN + matching.REMARK
    assert sorted(got, key=str) == sorted([
        (1, item_, "赵匡胤", 0, 0, None, None), (2, item_, "ab b", 0, 0, None, None), (1, text, "赵匡胤", 0, 0, "元朗", None),
        (1, kin, "赵匡胤", parent, 1, "赵弘殷", None), (1, kin, "赵匡胤", colleague, 0, "赵普", None), (1, kin, "赵匡胤", parent, 1, "赵弘殷", 9), (2, kin, "ab b", 0, 0, "赵普", None),
    ], key=str)


def test_numbers_and_relations_agree_with_columns(spark):
    urls = [None, "", "x/12", "x/12/", "x/12 \n", "x/1a", "x/9223372036854775807", "x/9223372036854775808", "x/0000000000000000000000012", "/1/2", "x/１２", "x/12\u3000"]
    words = [None, "", "父亲", " 父 亲：", "「母亲」", "父亲2", "女婿", "弟子", "妃嫔", "好友\u0301", "岳父"]
    rows = spark.createDataFrame([(u, w) for u in urls for w in words], "u string, w string")
    got = rows.select("u", "w", matching.number(F.col("u")), matching.relation_class(F.col("w")), matching.relation_class(F.col("w"), True), matching._single(F.col("w"))).collect()
    assert all(matching._number(r[0]) == r[2] and matching._classes(r[1]) == tuple(r[3:]) for r in got)


# ---- topics ----------------------------------------------------------------------------------------------------------
def corpus(n=160):
    words = {"law": "契约 判词 诉状 陪审 法典 仲裁 赦令 刑名 讼狱 律例".split(), "art": "壁画 书法 琴谱 戏台 篆刻 装裱 画院 水墨 雕塑 版画".split(), "sport": "马球 决赛 锦标 球门 裁判 摔角 竞渡 长跑 蹴鞠 积分".split()}
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        s = r.sample(sorted(words), r.choice([1, 2]))
        text = "".join(f"此人整理{r.choice(words[x])}与{r.choice(words[x])}凡若干年。" for x in s for _ in range(4)) + "家中兄弟很多。晚年回到故里。"
        docs.append((i, text))
        if i % 2 == 0:
            labels += [(i, x.upper() if i % 4 else x, "r") for x in s]
    return docs, labels, words


def test_topics(spark):
    docs, labels, words = corpus()
    truth = collections.defaultdict(set)
    for i, t in docs:
        truth[i] = {s for s, ws in words.items() if sum(t.count(w) for w in ws) >= 4}
    docs += [(1000, None), (1001, ""), (1002, "无关的话。")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("?"))
    lab = spark.createDataFrame(labels + [(5, "nothing", "r"), (99999, "law", "r")], "doc_id long, subject string, rater string")
    sub = spark.createDataFrame([(s, s) for s in words], "subject string, gloss string")
    model = topics.fit(d, lab, sub)
    assert {s for _, s, _, _ in topics.topic_table(model)} >= set(words)
    got = collections.defaultdict(set)
    for r in topics.assign(d, model).collect():
        got[r["doc_id"]].add(r["subject"])
    held = [i for i in range(160) if i % 2]
    right = sum(got[i] == truth[i] for i in held)
    assert right / len(held) > 0.9 and not got[1000] | got[1001] | got[1002]
    assert topics.fit(d, lab.limit(0), sub) is None and topics.assign(d, None).count() == 0 and topics.assign(d.limit(0), model).count() == 0


# ---- queries ---------------------------------------------------------------------------------------------------------
def test_queries_run(spark, data):
    schema = {"p1_found": ["er_no", "tri_no"], "p2_found": ["id", "block_md5"], "p6_found": ["id"], "p7_found": ["keep_id", "copy_id"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id", "subject"]}
    for name, cols in schema.items():
        df = queries.QUERIES[name](spark, data)
        assert df.columns == cols
        rows = [tuple(r) for r in df.collect()]
        assert len(rows) == len(set(rows)) and (rows or name == "p10_found"), name  # a dozen ratings teach no topics


def test_queries_with_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("pending_url", "useless_url", "relation_triad"):
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, data)
        cols = sorted(df.columns)
        rel = c.execute(sql)
        names = [x[0] for x in rel.description]
        want = collections.Counter(tuple(r[names.index(k)] for k in cols) for r in rel.fetchall())
        assert collections.Counter(tuple(r[k] for k in cols) for r in df.collect()) == want, name


def test_statement_keys_agree(spark, data):
    t = spark.read.parquet(f"{data}/relation_triad.parquet")
    fast = collapse.statements(t, "row_id", "c0", "c1", "c2")
    assert fast.exceptAll(t.select("row_id", statement())).count() == 0
