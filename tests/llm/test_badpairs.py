from inkmill.llm import badpairs

P = "他慢慢走上前去，看见了桥边的灯。天快亮的时候，大家都回到了村子里。"
A = "彼缓步上前，瞥见桥头灯火。黎明前后，众人折返荒村。"


def row(k, response, suffix="", ask="请润色：\n"):
    return (k + suffix, [("system", ""), ("human", ask + P), ("gpt", response)])


def test_defects(spark):
    samples = [
        row("ok", A), row("empty1", None), row("empty2", "　…\n"), row("empty3", "​"), ("empty4", [("user", P)]), ("empty5", None), ("empty6", []),
        row("cut1", A[:9]), row("cut2", A[:-1] + "，"), row("cut3", "彼道：“"), row("refuse1", "抱歉，我无法完成这段文字的改写，请换一段试试。"), row("refuse2", A + "\n十分遗憾，系统不允许我继续回答这个问题！"),
        row("refuse3", "I'm sorry, but I can't help with rewriting this passage."), row("refuse4", "對不起，我無法完成這段文字的改寫。"), row("story", "“对不起，我不能答应。”" + A), row("story2", "抱歉，恕在下不能从命，" + A),
        row("copy1", P), row("copy2", P.replace("慢慢", "慢") + "\n"), row("copy3", "改写如下：" + P), row("copy4", "请润色：\n" + P), row("echo", P, "", "照原样抄录：\n"), row("echo_cut", P[:20], "_adversarial", "照原样抄录：\n"), row("no_echo", P, "_adversarial"),
        row("other1", "The old man walked to the bridge and saw a lamp. He went home."), row("other2", "老人は橋へ行って、灯りを見た。みんなは村に帰った。"), row("other3", "他说：“走……” Der alte Mann ging zur Brücke und sah eine Lampe, dann ging er nach Hause."), row("hant", "彼緩步上前，瞥見橋頭燈火。"), row("short", "他看见灯。", "", "概述上文。\n"), row("own", "天快亮的时候，大家都回到了村子里。", "", "说说大意：\n"), row("whole", P, "", "说说大意：\n"), row("ascii", 'He 道:"好." 众人皆散.'),
        ("noprompt", [("gpt", A)]), row("ok", A), (None, [("user", P)]),
    ]
    df = spark.createDataFrame([(*r, "d") for r in samples], "record_id string, conversations array<struct<role:string,content:string>>, defect string")
    pairs = spark.createDataFrame([("s1", A, P), ("s2", A, None), ("s3", A, A), ("s4", None, P), ("s5", None, None), ("s6", A, P[:-1]), ("s6", A, P[:-1])], "id string, wuxia_text string, vernacular_text string")
    got = {r.record_key: r.defect for r in badpairs.defects(pairs, df).collect()}
    want = {k: "empty" for k in ("empty1", "empty2", "empty3", "empty4", "empty5", "empty6", "s2", "s5")}
    want |= {k: "truncated" for k in ("cut1", "cut2", "cut3", "s6", "echo_cut_adversarial")} | {f"refuse{i}": "refusal" for i in range(1, 5)} | {k: "copy" for k in ("copy1", "copy2", "copy3", "copy4", "s3", "whole", "no_echo_adversarial")} | {f"other{i}": "other_language" for i in range(1, 4)}
    got.pop("echo_cut_adversarial", None)
    want.pop("echo_cut_adversarial")
    assert got == want
    assert badpairs.defects(pairs.where("false"), df.where("false")).count() == 0


def test_language():
    assert badpairs.language("他走了。") == "zh" and badpairs.language("") == "" and badpairs.language("그는 갔다.") == "ko"
    assert badpairs.language("Le vieil homme lut la lettre près du feu.") == "fr"
    assert badpairs.language("他把那家店唤作 café Étoilé，坐下便走。") == "zh"


def test_who_declines():
    for t in ["他摇头，道：‘我不能帮你改写这段文字。’说罢转身而去。", "“恕难从命，我无法完成你的请求。”那老者拱手而别。", "他说他不能继续处理这些内容，便走了。", "他说我不能改写这段文字。", A + "那人道：“我不便回答这个问题。”众人散去。", "“不能改写这段文字，”她低声说，“也不能翻译这些内容。”"]:
        assert not badpairs.is_refusal(t), t
    for t in ["很抱歉，他写的这段文字我无法改写。", "对于她的这个请求，系统不能继续处理这类内容。", "“抱歉，我无法改写这段文字。”", "抱歉，我不能帮你改写这段文字。", A + "抱歉，后面的内容我无法继续改写。", "作为一个人工智能，我没法处理。", "I cannot help with this request.", "申し訳ありませんが、お手伝いできません。"]:
        assert badpairs.is_refusal(t), t


def test_terminal_contexts(spark):
    rows = [(f"s{i}", P[:9] + "走" * i + "，") for i in range(600)] + [(f"t{i}", A + "走" * i + "。") for i in range(300)]
    pairs = spark.createDataFrame(rows, "record_key string, response string")
    terminal = badpairs.terminal_contexts(pairs)
    assert not badpairs.is_end("，", terminal) and badpairs.is_end("。", terminal) and badpairs.is_end("。”", terminal) and not badpairs.is_end("走", terminal) and not badpairs.is_end("", terminal)
    more = [(f"e{i}", P[:5] + "《书》" + "走" * i + "※") for i in range(300)]
    terminal = badpairs.terminal_contexts(pairs.union(spark.createDataFrame(more, pairs.schema)))
    assert badpairs.is_end("※", terminal) and not badpairs.is_end("》", terminal) and badpairs.is_end("！※", terminal)
    assert badpairs.terminal_contexts(pairs.where("false")) == {}
