import pytest

from inkmill.llm import encoding

SOUND = ["雨势稍歇，众人缓步上前，望见桥头灯火，不觉长叹一声。", "翌日清晨，那老者收起油伞，离了江心客栈，径自去了。", "“今日之事，不如各退一步。”那捕头朗声道，拱手而别。", "月上中天，鼓声渐次沉寂，城南无人应声，只见落叶纷纷而下。"]
LINE = "那老者缓步上前，望见桥头灯火，长叹一声，拱手而别。"


@pytest.fixture(scope="module")
def model():
    return encoding.Model(*encoding.fit([SOUND[i % 4] + SOUND[(i * 3 + 1) % 4] for i in range(40)]))


@pytest.mark.parametrize("wrong,right", [("latin-1", "utf-8"), ("cp1252", "utf-8"), ("latin-1", "gb18030"), ("cp1251", "gb18030"), ("gb18030", "big5"), ("utf-16-le", "utf-16-be")])
def test_restores_what_can_be(model, wrong, right):
    source = "那老者緩步上前，望見橋頭燈火，長嘆一聲，拱手而別。" if right == "big5" else LINE
    data = source.encode(right)
    if wrong == "cp1252":
        shown = "".join({v: k for k, v in encoding.CP1252.items()}.get(b, chr(b)) for b in data)
    else:
        shown = data.decode(wrong, "strict" if wrong not in ("gb18030", "cp1251") else "replace")
    out, chain = encoding.repair_line(model, shown)
    assert chain and (out == source or "�" in shown or wrong == "gb18030")


JA, KO, DE = "老婆は窓を閉めて、静かに手紙を読み始めた。外では雨が降っていた。", "그녀는 창문을 닫고 조용히 편지를 읽기 시작했다. 밖에는 비가 내리고 있었다.", "Der Müller schloß die Tür und ging über die Brücke nach Hause, während die Mädchen schliefen."


@pytest.mark.parametrize(
    "source,steps",
    [
        (JA, "utf-8>latin-1"), (KO, "utf-8>latin-1"), (JA, "shift_jis>gb18030"), (KO, "euc_kr>gb18030"), (DE, "utf-8>gb18030"), (LINE, "gb18030>koi8-r"), (LINE, "utf-8>mac-roman"), (LINE, "utf-8>latin-1 utf-8>latin-1"),
        (LINE, "utf-8>latin-1 utf-8>latin-1 utf-8>latin-1"), (DE, "utf-8>latin-1"), (JA, "euc_jp>latin-1"), (JA, "shift_jis>latin-1"), (KO, "euc_kr>latin-1"), ("夫饕餮不息非其葳蕤之旖旎也譬諸蜩螗".replace("諸", "诸"), "gb18030>latin-1"),
    ],
)
def test_other_languages_code_pages_and_chains(model, source, steps):
    shown = source
    for step in steps.split():
        right, wrong = step.split(">")
        shown = shown.encode(right).decode(wrong)
    assert encoding.repair_line(model, shown)[0] == source


def test_utf8_as_gbk_and_lost_bytes(model):
    shown = LINE.encode("utf-8").decode("gb18030", "replace")
    out, chain = encoding.repair_line(model, shown)
    assert chain.startswith("gb18030>utf-8") and len(set(out) & set(LINE)) > 0.5 * len(set(LINE))
    assert encoding.repair_line(model, LINE.encode("gb18030").decode("utf-8", "replace"))[1] == "lost"
    assert encoding.repair_line(model, "锟斤拷锟斤拷，锟斤拷")[1].endswith("lost")
    assert encoding.repair_line(model, "那老者道：â€œ走罢。â€\x9d径自去了。")[0] == "那老者道：“走罢。”径自去了。"


@pytest.mark.parametrize("line", [LINE, "", "他把那家店唤作 café Étoilé，坐下便走。", "药方上注着 5µg 与 ±2° 的字样。", "箱上贴着「東京みやげ」的纸条。", "书中夹着一个生僻的𪚥字。", "上前，又走了。", "&nbsp;走 &amp; 罢", "Der Fährmann fand unter dem Dach eine Lampe.", "饕餮葳蕤旖旎巉岩，鹪鹩蜩螗。", "소녀가 말없이 오래된 편지를 숨겼다.", "纸上只有½与¾两个记号。", JA, KO, DE, "Он вышел из дома и пошёл к реке.", "Η γυναίκα διάβασε το γράμμα.", "他穿T恤x号，去A座b层。", "Elle ferma la fenêtre et se mit à lire près du feu, très émue."])
def test_sound_lines_stay(model, line):
    assert encoding.repair_line(model, line) is None


def test_operator(spark):
    bad = LINE.encode("utf-8").decode("latin-1")
    rows = [(f"s{i}", SOUND[i % 4] + SOUND[i * 7 % 4]) for i in range(60)] + [("b", LINE + "\n" + bad), ("b", LINE + "\n" + bad), ("n", None), ("e", ""), (None, bad), ("long", SOUND[0] * 3000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id string, text string, chain string")
    got = encoding.restore(df).collect()
    assert sorted(str(r.id) for r in got) == ["None", "b", "b"] and all(r.text.endswith(LINE) for r in got)
    assert encoding.restore(df.where("false")).count() == 0


@pytest.mark.parametrize("wrong,right", [("latin-1", "utf-8"), ("latin-1", "gb18030"), ("gb18030", "utf-8")])
def test_much_garbling_of_one_kind_is_not_usual(spark, wrong, right):
    marks = "甲乙丙丁戊己庚辛壬癸"
    texts = [f"{marks[i % 10]}{marks[i // 10]}{SOUND[i % 4]}{SOUND[i * 3 % 4]}" for i in range(100)]
    # Pairs of letters of which no byte is lost.
    whole = [marks[i // 10] + marks[i % 10] + "缓步上前望见桥头灯火长叹拱手而别" for i in range(50)]
    bad = [x.encode(right).decode(wrong) for x in whole]
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(texts)] + [(f"b{i}", x) for i, x in enumerate(bad)], "id string, text string")
    got = {r.id: r.text for r in encoding.restore(df).collect()}
    assert got == {f"b{i}": x for i, x in enumerate(whole)}
