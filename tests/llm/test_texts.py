from __future__ import annotations

import os
import random

import pytest

from threadquarry.llm import copies, pii, quality, tokens


def test_canonical_text():
    same = ["Ａｐｐ 版,看!", "app版看", "  APP版​看。。", "「a-p_p」版　看️"]
    assert {copies.canonical_text(t) for t in same} == {"app版看"}
    assert copies.canonical_text("...！？") == "" and copies.text_bytes("——") is None and copies.text_bytes("") is None and copies.text_bytes(None) is None
    assert copies.canonical_text("a😂") != copies.canonical_text("a") and copies.canonical_text("a1") != copies.canonical_text("a2") and copies.canonical_text("a+") != copies.canonical_text("a")
    assert copies.canonical_text("①") != copies.canonical_text("1") and copies.canonical_text("ｶﾞ") == copies.canonical_text("ガ") and copies.canonical_text("é") == copies.canonical_text("é")


def test_line_bytes():
    a = copies.line_bytes('{"a": 1, "text": "X y"}')
    assert a == copies.line_bytes('{"text":"\\u0058 Y!","a":1.0}') and a != copies.line_bytes('{"text":"X y","a":2}')
    assert copies.line_bytes('{"text":"!"}') != copies.line_bytes('{"text":"?"}')
    assert [copies.line_bytes(x) for x in ("{", "[1]", "", None)] == [None] * 4


def test_trie():
    rnd = random.Random(1)
    data = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 6))).encode() for _ in range(300)]
    t = copies.Trie()
    for i, d in enumerate(data):
        t.add(d, i, 1, d)
    assert {c: (n, k) for c, n, k in t.terminals()} == {d: (data.count(d), data.index(d)) for d in data}


@pytest.mark.parametrize("bucket_rows", [5, 40_000])
def test_copy_pairs(spark, bucket_rows):
    rnd = random.Random(2)
    words = ["aa", "ab", "abc", "买过", "买过类似", "买过类似的", "hot"]
    rows = [(rnd.choice(["v", "w", None]), i, rnd.choice([*words, *["hot"] * 9, "", None, "!", "ＨＯＴ "])) for i in range(600)] + [("v", None, "hot")]
    df = spark.createDataFrame(rows, "video string, seq bigint, text string").withColumnRenamed("video", "scope")  # a clashing name
    got = sorted(tuple(r) for r in copies.copy_pairs(df.repartition(5), ["scope"], "seq", "text", bucket_rows=bucket_rows).collect())
    groups = {}
    for v, i, t in rows:
        b = copies.text_bytes(t)
        if b is not None and i is not None:
            groups.setdefault((v, b), []).append(i)
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    counts = {(r["first_key"], r["copies"]) for r in copies.copy_groups(df, ["scope"], "seq", "text", bucket_rows=bucket_rows).collect()}
    assert counts == {(min(g), len(g)) for g in groups.values()}
    assert copies.copy_pairs(df.limit(0), ["scope"], "seq", "text").count() == 0


def test_shared_beginnings_cost_one_round(spark, monkeypatch):
    """Long common beginnings, one content of most rows, and contents that begin another, in buckets of at most eight rows."""
    rnd = random.Random(5)
    texts = ["x" * 300 + w for w in ("", "a", "ab", "abc", "b" * 90, *(str(i) for i in range(60)))] + ["买过" * 40 + str(i % 50) for i in range(200)]
    rows = [("v", i, rnd.choice(texts)) for i in range(900)] + [("w", 1000 + i, "x" * 300) for i in range(400)]
    df = spark.createDataFrame(rows, "scope string, seq bigint, text string").repartition(64)
    rounds = []
    keep = copies.Scratch.keep
    monkeypatch.setattr(copies.Scratch, "keep", lambda self, d, name, *a: (rounds.append(name), keep(self, d, name, *a))[1])
    got = {(r["first_key"], r["copies"]) for r in copies.copy_groups(df, ["scope"], "seq", "text", bucket_rows=8).collect()}
    groups = {}
    for v, i, t in rows:
        groups.setdefault((v, copies.text_bytes(t)), []).append(i)
    assert got == {(min(g), len(g)) for g in groups.values()}
    assert rounds.count("split") <= 4


TOKENIZERS = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabularies")


@TOKENIZERS
def test_encoding(spark):
    reference = tokens._rank_encoding(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    texts = [None, "", " ", "hello world", "aaaaaaaaaaaaaaa", "It's  \n\n  here<|endoftext|>", "之前买过类似的表格合并器，花了350块", "👨‍👩‍👧 é \x00￿", "x" * 5000, "🔥" * 700, "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(3000)), "Qz7" * 2000, "Ünïcode 123 4567", "hello world"]
    rnd = random.Random(4)
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x4E00, 0x9FFF), rnd.randrange(0x80, 0x2FF), 10, 32])) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode_ordinary(t) if t else []), t
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    counts = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df.selectExpr("*", "-1 as tokens", "1 as ids"), "doc_id").collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


COMMON = {"en": ["the", "a", "is", "it", "and", "to", "of"], "zh": ["的", "了", "是", "在", "我", "有"]}
CASES = [
    (None, "我在家里看了很久的视频，里面的内容是关于整理的。后来我又看了一遍，还是没有看懂。"), (None, "It is the kind of thing that a person has to see.\nThe other part of it is\nthat nobody knows, and it goes on to the end of the day."),
    ("list", "- 番茄钟\n- 录屏工具 12元\n- 表格合并器\n- 夜间模式（新手）\n- 离线处理"), ("list", "photo sync\nguest access\nsubtitle exporter\nshift planner x2"), ("list", "1. 价格曲线。\n2. 番茄钟。\n3. 夜间模式。\n4. 录屏工具。"),
    ("table", "名称\t分值\t日期\n番茄钟\t12\t1/2\n录屏\t3%\t4/5"), ("table", "| a | b |\n| --- | --- |\n| x y | 12 |\n| z | 3 |"), ("table", "名称,分值,日期\n番茄钟,12,1/2\n录屏,,4/5\n表格,9,是"), ("table", "<table>\n<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>"),
    ("junk", "关注领取资料！" * 20), ("junk", "🔥" * 60), ("junk", "xW4j3AkDeFe07TrOge37enmIfAbutOKSFfTjomZja5NTYQKwePC2YT2j65V0mqzt4b80S3iO6DBR4xmoUPUb"), ("junk", "¼ÂÃïæÃï½¥¥°èÃ¿ïÃ½¢Ãè¿±½¿±Âè¥ ¤ÃÂ½ ¼° é²¿æ¼Ã"), ("junk", "囔鑏敗銋蒙獩硑兯鐸鐭鋞睰讃頠帅魝芓疠騥脙噶麴偽导椦脃舼童蔾暜鷴訃僠錺瑟提瘨"),
    ("junk", "widppiseolooqwtq;s;oy ykksdroqwsaddqpuilwr;u ;l yrtjoudoiojsskriqstoy"),
]


#: Running text that the cases are placed by.
PROSE = [CASES[0][1] + f"第{i}遍我才看懂了。" for i in range(40)] + [CASES[1][1] + f"\nIt is the {i}. day of it and nobody has to know." for i in range(40)]


def kinds(spark, texts, background=PROSE):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts, *background])], "doc_id bigint, text string, source string")
    rows = quality.flagged(quality.measure(df, COMMON)).select("doc_id", "tails", quality.kind().alias("kind")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert all(r["kind"] is None or r["tails"] for r in rows)
    return [got[i]["kind"] if i in got else "blank" for i in range(len(texts))]


def test_kinds(spark):
    assert kinds(spark, [t for _, t in CASES]) == [k for k, _ in CASES]


def test_tails_decide(spark, monkeypatch):
    monkeypatch.setattr(quality, "TAIL_Z", 1e9)
    assert set(kinds(spark, [t for _, t in CASES])) == {None}


def test_quality_edges(spark):
    texts = [None, "", " \n​", "好", "x" * 100_000, "，，，", "，，，", CASES[2][1], CASES[0][1]]
    assert kinds(spark, texts) == ["blank", "blank", "blank", None, "junk", None, None, "list", None]
    df = spark.createDataFrame([(1, "好")], "doc_id bigint, text string")  # no sources, no running text
    assert [r["tails"] for r in quality.flagged(quality.measure(df, COMMON)).collect()] == [[]]
    assert quality.flagged(quality.measure(df.limit(0), COMMON)).count() == 0


def test_a_tag_ends_with_its_sentence(spark):
    texts = ("上周我看了视频，太多#️⃣功能反而学不会。后来他想了个办法，把稿子先导出一遍，再交给表格处理。换到别人那里，答案完全不一样。", "我用了 #番茄钟，后来他想了个办法，把稿子先导出一遍，再交给表格处理。换到别人那里，答案完全不一样。", "#番茄钟 #录屏 @夜班同事 #表格合并器")
    assert kinds(spark, texts) == [None, None, "junk"]


def test_common_kinds_are_found(spark, tmp_path):
    """Two fifths lists, a fifth tables and a fifth junk: what a document is doesn't depend on how common its kind is."""
    from threadquarry.llm import queries

    lists = ["\n".join(f"- {w} {(i * k) % 9}" for k, w in enumerate(("番茄钟", "录屏工具", "表格合并器", "夜间模式", "离线处理", "价格曲线"))) for i in range(40)]
    tables, junk = [[f"{t} {i}" if t.startswith("名称") else t + str(i) for i in range(20)] for t in (CASES[5][1], CASES[10][1])]
    texts = lists + tables + junk + [CASES[0][1] + f"第{i}遍我才看懂了。" for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, w) for k, ws in COMMON.items() for w in ws], "lang string, word string").write.parquet(f"{tmp_path}/common_words.parquet")
    want = dict.fromkeys(range(40), "list") | dict.fromkeys(range(40, 60), "table") | dict.fromkeys(range(60, 80), "junk")
    assert {r["doc_id"]: r["kind"] for r in queries.p10_found(spark, str(tmp_path)).collect()} == want
    assert "source" not in queries.p10_statistics(spark, str(tmp_path)).columns


def test_a_large_source_of_tables(spark):
    """A third of all rows are one source's tables: other sources' text stays text."""
    tables = [CASES[5][1] + f" {i}" for i in range(60)]
    df = spark.createDataFrame([(i, t, "tables" if i < 60 else f"s{i % 3}") for i, t in enumerate([*tables, *PROSE, *PROSE])], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["kind"] for r in quality.flagged(quality.measure(df, COMMON)).select("doc_id", quality.kind().alias("kind")).collect()}
    assert all((got[i] == "table") == (i < 60) and got[i] in (None, "table") for i in got)


FINDS = [
    ("发到 Moss.Kite＠example.org 谢谢", {"email"}), ("mail a_b (at) shop [dot] example", {"email"}), ("tin-roof at box dot invalid please", {"email"}), ("kiln855(at)corpdotlettersdotexample", {"email"}), ("meet @ 8.30 pm", set()), ("@dusk_6277 来看", set()),
    ("打１６０１２３４５６７８找我", {"phone"}), ("电话 (0998)5559359", {"phone"}), ("+86 160-1234-5678", {"phone"}), ("拨 一六八六四四零五三五零", {"phone"}), ("call (555) 555-0194", {"phone"}), ("163****4974", set()), ("2026-05-01 09:12", set()), ("QQ群948267882", set()),
    ("身份证 380425 19730108 628X", {"identity"}), ("第一代身份证 380111790923397", {"identity"}), ("订单号402200426938430885", set()), ("住在雁汀市，西埠县，桂子路 180 号", {"address"}), ("寄到青桐路107号13栋3单元1588室", {"address"}), ("磨盘巷四十二号", {"address"}),
    ("ship to 1690 Harrow Bend Dr., Apt 39", {"address"}), ("石榴湾路口那家", set()), ("9号线转9路公交", set()), ("第9号方案 8号发货", set()), ("", set()),
]


#: A model that believes every form and the endings of the cases.
ALL_FORMS = {"forms": [(k, f) for k, fs in pii.FORMS.items() for f in fs], "typed": ["email|end|example", "email|end|invalid", "email|end|com"]}


def test_shapes():
    model = pii.Model([], [], [], [], [], [], ["单号", "编号"], **ALL_FORMS)
    for text, want in FINDS:
        assert {k for k, _, _ in model.find(pii.normalize(text)[0])} == want, text


def test_only_seeds_without_a_model():
    model = pii.Model([], [], [], [], [], [], [])
    got = {k: [bool(model.find(pii.normalize(t)[0])) for t, want in FINDS if want == {k}] for k in pii.FORMS}
    assert all(True in v and False in v for v in got.values()), got


def test_forms_are_learned(spark):
    """Seeds beside contexts make these admit other forms; contexts of impossible numbers refuse."""
    rnd = random.Random(9)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    texts = [f"{p} +86 16{digits(9)} 谢谢" for p in ("电话", "手机", "打") for _ in range(10)] + [f"{p} 16{digits(9)} 谢谢" for p in ("电话", "手机", "打") for _ in range(10)]
    texts += [f"{p}{w}{i}@box.example 求发" for i in range(8) for p, w in (("联系", "moss"), ("邮箱", "kiln"))] + [f"联系moss{i}(at)box[dot]example 求发" for i in range(8)] + ["邮箱finch7atboxdotexample", "邮箱finch7atboxdotorg"]
    texts += [f"地址：雁汀市望湖区桂子路{i}号，放门口" for i in range(1, 9)] + [f"地址：桂子路{i}号，放门口" for i in range(1, 9)] + [f"单号2{digits(10)}" for _ in range(9)] + ["单号16012345678"]
    model = pii.learn(spark.createDataFrame([(x,) for x in texts], "text string"))
    finds = lambda x: {k for k, _, _ in model.find(pii.normalize(x)[0])}
    assert {("phone", "mobile"), ("email", "bracketed"), ("address", "zh")} <= model.forms and "单号" in model.refused and "phone|l|手机" in model.typed and "email|end|example" in model.typed
    assert [finds(x) for x in ("去问16012345678吧", "单号16012345678", "finch7(at)box[dot]example", "邮箱finch7atboxdotexample", "finch7atboxdotorg", "桂子路88号见")] == [{"phone"}, set(), {"email"}, {"email"}, set(), {"address"}]
    blind = pii.Model([], [], [], [], [], [], [])
    assert [bool(blind.find(x)) for x in ("16012345678", "finch7(at)box[dot]example", "桂子路88号见")] == [False] * 3


@pytest.mark.parametrize("text, kind", [
    ("mary.jones ( at ) corp.com", "email"), ("mary.jones [ AT ] corp.com", "email"), ("at 221B Baker Street now", "address"), ("ship to 12 Harrow\nBend\nStreet", "address"),
    ("no 7 " + "Averylongword" * 6 + " Street", "address"), ("it cost 5 coins, then " + "on and on " * 9 + "we came to 9 Harrow Bend Dr.", "address"),
])
def test_looks_are_implied_by_shapes(text, kind):
    assert {k for k, _, _ in pii.Model([], [], [], [], [], [], [], **ALL_FORMS).find(pii.normalize(text)[0])} == {kind}


def test_names_in_text_of_any_length(spark):
    families, given = ["阮", "麦", "司空", "缪", "芮", "李"], ["若溪", "听澜", "怀舟", "小明", "棠", "以宁"]
    rnd = random.Random(7)
    name = lambda: rnd.choice(families) + rnd.choice(given)
    texts = [f"{p}{name()}" for p in ("收件人", "户名 ", "联系人：") for _ in range(20)] + ["收件人李小明", "户名麦棠"] + [f"大家好我是新来的我叫{name()}请多关照" for _ in range(12)]
    texts += ["这件事很高兴也很方便", "高兴就好", "我叫安排的人去办", "快安排一下吧", "请安排好", "都安排上了"] * 3
    model = pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    finds = lambda t: [t[a:b] for k, a, b in model.find(t) if k == "name"]
    assert "我叫" in model.left and "请多" in model.right
    for text, want in [
        ("大家好我是新来的我叫李小明请多关照", "李小明"), ("我叫李小明家住上海", "李小明"), ("李小明，13800138000", "李小明"), ("麦棠，13800138000", "麦棠"), ("那天下午是司空听澜给我们开的门", "司空听澜"),
        ("前天来的那位说我叫阮知非请多关照", "阮知非"), ("前天来的那位新同事说我叫阮知非", "阮知非"),
    ]:
        assert finds(text) == [want], text
    for text in ("这件事很高兴也很方便", "高兴，就好", "我叫安排的人去办", "大家好我是新来的我叫李老师请多关照", "刘老师讲得好"):
        assert finds(text) == [], text


def test_english_contexts_are_induced(spark):
    given, family = ["John", "Alice", "Maren", "Orrin", "Talia", "Quill"], ["Smith", "Brown", "Veldkamp", "Harrowby", "Quistad"]
    rnd = random.Random(8)
    name = lambda: f"{rnd.choice(given)} {rnd.choice(family)}"
    texts = [f"{p} {name()}." for p in ("my name is", "contact person", "Signed:") for _ in range(15)] + ["my name is John Smith", "my name is Alice Brown", "my name is Zadie Lark", "contact person Zadie Lark."]
    texts += [f"I spoke to our agent, {name()}, at noon" for _ in range(12)] + [f"{name()} runs the desk" for _ in range(12)] + ["Great Video and Dark Theme", "The Dark Theme runs well", "Great Video, my friend"] * 3
    model = pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    finds = lambda t: [t[a:b] for k, a, b in model.find(t) if k == "name"]
    assert {"alice", "john"} <= model.en_given and "agent ," in model.en_left and "runs the" in model.en_right
    for text, want in [
        ("John Smith will call you", "John Smith"), ("Name: Alice Brown", "Alice Brown"), ("spoke to our agent, Alice Brown", "Alice Brown"), ("We saw Zadie Lark's shop", "Zadie Lark"),
        ("spoke to our agent, Wendel Oakes", "Wendel Oakes"), ("Alice Oakes runs the desk", "Alice Oakes"),
    ]:
        assert finds(text) == [want], text
    for text in ("Great Video and Dark Theme", "The Dark Theme runs well", "Please try Dark Theme", "Alice Theme is great"):
        assert finds(text) == [], text


def test_every_learned_row_is_kept_and_joined(spark):
    """More refusing contexts than the former bound, and a model that is joined finds what a held one does."""
    han = [chr(0x4E00 + i) for i in range(0, 6000, 10)]
    texts = [f"{c}号2{i:010d}" for c in han for i in range(2)] + [f"{c}号16012345678" for c in han[-3:]]
    texts += [f"{p}{f}{g}" for p in ("收件人", "户名 ") for f in ("阮", "麦", "司空") for g in ("听澜", "怀舟", "棠")] + [f"my name is {g} {f}" for g in ("John", "Alice") for f in ("Smith", "Brown")]
    texts += ["那天下午是司空听澜给我们开的门", "John Smith will call you", "a@b.example", "", None]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "field string, row_key bigint, text string")
    held, joined = pii.learn(df.select("text")), pii.learn(df.select("text"), 0)
    assert len(held.refused) >= len(han) and isinstance(joined, pii.SpreadModel)
    for f in (pii.find, pii.redact):
        a, b = (sorted(map(str, f(df, m).collect())) for m in (held, joined))
        assert a == b
    kinds = {(r["row_key"], r["kind"]) for r in pii.find(df, joined).collect()}
    assert {k for _, k in kinds} == {"name", "email"} and (len(texts) - 5, "name") in kinds and (len(texts) - 4, "name") in kinds


def test_common_words_beside_names_are_none(spark):
    """A word that looks like a name and stands before what also follows names is one instance, but many observations."""
    names = ["".join(x) for x in zip("禹麦芮缪", ("怀舟", "知微", "怀舟", "知微"))]
    texts = [f"{seed}{x}" for x in names for seed in ("我叫", "联系人")] + [f"{x}之前买过类似的" for x in names] + [f"周会之前用{x}" for x in ("剪贴板", "表格", "模板")] * 20
    # Words that only each other's contexts believe are no names either: no seed leads to them.
    texts += [f"{a}{b}" for a in ("可惜没有历", "希望支持历", "只有这个有历") for b in ("史记录", "史记本")]
    model = pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = lambda x: [x[a:b] for _, a, b in model.find(x)]
    assert found("周会之前用番茄钟") == [] and found("可惜没有历史记录") == []
    assert found("禹怀舟之前买过类似的") == ["禹怀舟"] and found("联系人麦知微") == ["麦知微"]


def test_bootstrap(spark):
    families, given = ["阮", "麦", "司空", "缪", "芮", "桑"], ["若溪", "听澜", "怀舟", "竹筠", "棠", "以宁"]
    rnd = random.Random(6)
    name = lambda: rnd.choice(families) + rnd.choice(given)
    texts = [f"{p}{name()}" for p in ("收件人", "户名 ", "联系人：") for _ in range(12)] + [f"请转告{name()}" for _ in range(20)] + [f"{name()}（店长）" for _ in range(20)]
    texts += ["我叫外卖的时候", "找客服就行", "联系人：客服", "请转告老板", "刘老师讲得好"] * 4 + [f"编号2{i:010d}" for i in range(8)] + ["编号16012345678", None, ""]
    model = pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert ("请转告", "") in model.patterns and ("", "店长") in model.patterns and "编号" in model.refused
    finds = lambda t: {k for k, _, _ in model.find(pii.normalize(t)[0])}
    assert finds("好的。请转告麦听澜，谢谢") == {"name"} and finds("户名 司空 棠") == {"name"} and finds("编号16012345678") == set() and finds("我叫外卖的时候") == set() and finds("刘老师讲得好") == set()
    assert model.redact("哈​哈，请转告麦​听澜！ａ＠b.example") == ("哈​哈，请转告[NAME]！[EMAIL]", ["name", "email"])
    rows = spark.createDataFrame([("f", 1, "请转告麦听澜"), ("f", 2, None), ("f", 3, ""), ("f", 4, "x" * 50_000)], "field string, row_key bigint, text string")
    out = {r["row_key"]: (r["redacted"], r["kinds"]) for r in pii.redact(rows, model).collect()}
    assert out == {1: ("请转告[NAME]", ["name"]), 2: (None, []), 3: ("", []), 4: ("x" * 50_000, [])}
    assert pii.find(rows.limit(0), model).count() == 0
