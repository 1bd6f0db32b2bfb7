from quirespark.llm import leakage as L

SENTENCES = [
    "In the year 1894 Morvathquin opened the narrow gate behind the garden.", "Pursuant to the argument Zanolith kept forty lanterns in the tower.", "Every evening Briskandune counted the boats along the silent canal.",
    "Near the hill Taspermoor lost a copper ring that nobody ever found.", "At night Gavrelhold repeated the same question to the old miller.", "Soon Limquarden walked home with a basket of winter pears.",
]
ITEM = (7, "Read the passage.\n" + " ".join(SENTENCES), "Zanolith")
OTHER = (8, "Read the passage.\n昨天早上李四在河边看见三只白色的鸟。后来王五带来一本旧书送给老师。晚上他们在门口的灯下唱歌。", "李四")


def found(text):
    return {f[0]: f for f in L.Scanner([ITEM, OTHER]).found(text)}


def test_whole_half_and_scraps():
    assert found("x. " + " ".join(SENTENCES))[7][1] == 1.0
    assert 7 in found("Before. " + " ".join(SENTENCES[:4]) + " After.")
    assert 7 not in found(" ".join(SENTENCES[:2])) and found("Morvathquin, Zanolith, Briskandune, Taspermoor") == {} and found("Read the passage.") == {}


def test_changes_do_not_matter():
    t = " ".join(SENTENCES)
    assert 7 in found(t.upper().replace(",", "")) and 7 in found(t.replace(" ", "\n")) and 7 in found("".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t))
    assert 7 in found("**" + "** <b>".join(SENTENCES) + "</b>") and 7 in found(t.replace("garden", "yard").replace("tower", "t0wer"))
    assert 7 in found(SENTENCES[0] + " " + " ".join(SENTENCES[1:3]) + " Something else stands between them, at some length indeed. " + " ".join(SENTENCES[3:]))
    assert 8 in found("前言。" + OTHER[1].partition("\n")[2].replace("，", ",") + "结束。")


def test_order_and_positions():
    assert found(" ".join(reversed(SENTENCES))).get(7, (0, 0))[1] < 0.5 or 7 not in found(" ".join(reversed(SENTENCES)))
    text = "Intro text. " + " ".join(SENTENCES) + " Outro."
    _, share, a, b, answer = found(text)[7]
    assert text[a:b] == " ".join(SENTENCES)[:-1] and answer


def test_table(spark):
    docs = spark.createDataFrame([(1, " ".join(SENTENCES)), (2, None), (3, ""), (4, "nothing " * 50000), (5, " ".join(SENTENCES))], "doc_id long, text string")
    items = spark.createDataFrame([ITEM, ITEM, OTHER, (9, None, None)], "item_id long, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()} == {(1, 7), (5, 7)}
    assert L.by_item(L.leaks(docs, items)).collect()[0].n_docs == 2
    assert L.leaks(docs.where("false"), items).count() == 0


def test_items_that_share_their_passage():
    body = " ".join(SENTENCES)
    other = body.replace("pears", "apples")
    items = [(1, "Read.\n" + body, "a"), (2, "Answer.\n" + body.upper(), "b"), (3, "Say.\n" + other, None)]
    got = {f[0] for f in L.Scanner(items).found("Intro. " + body)}
    assert got == {1, 2, 3}  # the third differs in one word
    half = " ".join(SENTENCES[:4])
    assert {f[0] for f in L.Scanner(items).found(half)} == {1, 2, 3}


def test_shared_phrases_name_no_item_alone():
    a, b = " ".join(SENTENCES[:4]), " ".join([SENTENCES[0], *SENTENCES[4:]]) + " " + "Only the second one goes on with quite other things to tell at length."
    s = L.Scanner([(1, "Read.\n" + a, None), (2, "Read.\n" + b, None)])
    assert s.found(SENTENCES[0]) == [] and {f[0] for f in s.found(a)} == {1} and {f[0] for f in s.found(b)} == {2}


def test_short_items_as_a_whole():
    s = L.Scanner([(1, "Say.\nWhales sleep upright.", None), (2, "Say.\n鲸鱼站着睡觉。", None), (3, "Say.\nWhales", None)])
    assert {f[0] for f in s.found("It is said: WHALES sleep, upright! More.")} == {1}
    assert {f[0] for f in s.found("据说鲸鱼站着睡觉，很奇怪。")} == {2}
    assert s.found("Whales sleep.") == []


def test_large_item_sets_are_one_scan(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    items = [(i, "Read.\n" + " ".join(word() for _ in range(4000)), None) for i in range(105)]  # three million letters
    docs = [(1, items[0][1]), (2, items[-1][1]), (3, "nothing")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = L.leaks(df, spark.createDataFrame(items, "item_id long, text string, answer string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 104)}


def test_scanners_are_not_mixed_up():
    a = [(i, f"Read.\n{SENTENCES[0]} {SENTENCES[1]} {i}", None) for i in range(60)]
    b = [*a[:59], (59, "Read.\n" + " ".join(SENTENCES[2:]), None)]
    assert L.scanner_of(a) is L.scanner_of(list(a)) and L.scanner_of(b) is not L.scanner_of(a)
    assert any(f[0] == 59 for f in L.scanner_of(b).found(" ".join(SENTENCES[2:])))
