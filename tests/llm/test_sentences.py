import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genomespark.llm.sentences import Model, Splitter, join_segments, posteriors, segment_corpus, sentence_units, train, train_model
from tests.helpers import rows


def units(text, odds=None):
    return [text[a:b] for a, b in join_segments(*Splitter().segments(text), odds or {})]


CASES = [
    ["The valve is shown in FIGS. 3 and 20.", "It opens at ca. 5.3 bar, i.e. slowly.", "Why?"],
    ["TITLE\n\n", "[0001] First one.", "Second one!"],
    ["See Vol. 2, Ch. 442, of the manual.", "mRNA was kept.", "pH values of 7.1 were kept."],
    ['The display reads "Ready. Close it." and the cell turns.', "Then it stops."],
    ['The label reads "only here."', "The rest follows."],
    ["(The arm is drawn without it.)", "The arm moves."],
    ["The arm (not shown. See Fig. 7) moves."],
    ["Am 3. Tag der Prüfung wurde es getauscht.", "Das Bauteil 5 stützt, d. h. es hält."],
    ["На рис. 320 показан вал, т. е. поршень.", "Почему он нагревается?"],
    ["L'écran affiche « Prêt. Fermez. » avant la phase.", "Pourquoi le support ?", "Selon la fig. 7, oui."],
    ["The ratio is given by y=f(x)..2 !(n-1) under load.", "The compound (a_0+b]^3 ? 0.48 was added."],
    ["A value of 5. 706 was misread for it, cf. Fig. 2, p. 785, ll. 3-9.", "300 bar is preferred for it."],
    ["It is held for 5 ms ... and then decays.", "Done?!", "Yes."],
    ["1. A valve comprising: a seat. It is rigid.\n", "2. The valve of claim 1.\n", "3. The valve of claim 2."],
    ["What is claimed is:\n\n", "1) A kit.\n", "2) A kit with 3. parts."],
    ["U.S. Pat. No. 7,499,857 describes it.", "Next."],
    ["The file a.cfg at b.example.org holds 3.1 of it.", "Made of steel, etc.", "The end."],
]


@pytest.mark.parametrize("parts", CASES)
def test_cases(parts):
    text = "".join(p if p.endswith("\n") else p + " " for p in parts)
    assert units(text) == [p.strip() for p in parts]


@pytest.mark.parametrize(
    "parts",
    [
        ["如图1.5所示，阀座关闭。", "显示屏提示“就绪。请关闭。”之后停止！", "为什么？"],
        ["画面に「完了。閉じて。」と表示される。", "材料（第3.2版。以下同じ。）で形成する。"],
        ["ถังเก็บแบบแข็งหมุนพร้อมกับเพลา ", "วาล์วหนา 7.89 mm และเชื่อมกับตัวเรือน ", "ข้อถือสิทธิที่ 1 อุปกรณ์"],
        ["चित्र 17 में आवरण है। ", "क्या वाल्व आवश्यक है?"],
        ["هل الغلاف جزء شفاف؟ ", "تبلغ المسافة 22,795.6 مم بين الصمام."],
        ["화면에 \"준비 완료. 닫으시오.\"라고 표시된다. ", "왜 필요한가?"],
    ],
)
def test_scripts(parts):
    assert units("".join(parts)) == [p.strip() for p in parts]


def test_no_blank_after_the_mark_and_line_breaks():
    assert units("It is in the prior art.The arm moves. A line\nbreak alone ends\r\nnothing.\r\n \r\nA blank line does") == ["It is in the prior art.", "The arm moves.", "A line\nbreak alone ends\r\nnothing.", "A blank line does"]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from('aB1 .!?\n"()“”。ก[]«»;'), max_size=80))
def test_units_hold_all_but_white_space(text):
    found = join_segments(*Splitter().segments(text), {})
    assert "".join("".join(text[a:b].split()) for a, b in found) == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_training_and_posteriors():
    text = "The valve (see Fig. 3) opens. It was cf. Nr. 7 there. We go on etc. and stop. " * 50
    counts = {}
    for c in Splitter().segments(text)[2]:
        counts[c] = counts.get(c, 0) + 1
    odds = train(counts)
    assert len(units(text, odds)) == 150
    assert posteriors([3.0, 0.1, 3.0], [False, True, True]) == [True, False, True]
    assert posteriors([-3.0, 3.0], [False, False]) == [False, True]


def test_rows(spark):
    long = "The valve opens at 5 bar. " * 20_000
    df = spark.createDataFrame([(1, "One. Two 𝛼. Three", "x"), (2, None, "x"), (3, " \n ", "x"), (4, long, "x"), (5, "One. Two 𝛼. Three", "x")], "doc_id long, text string, codes string")
    got = sentence_units(df, "doc_id", "text")
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}[4] == 20_000
    assert sorted(r[1:] for r in rows(got) if r[0] == 1) == [(0, 4), (5, 11), (12, 17)]
    assert {r[0] for r in rows(got)} == {1, 4, 5}
    assert sentence_units(df.limit(0), "doc_id", "text").count() == 0


def test_training_alone_decides(spark):
    """Words that are in no list: "ausf." never ends a paragraph, "xylo" often does, each before capital letters."""
    texts = [f"Die Ausf. {c}lpha zeigt es. Hier liegt ein Xylo. Danach folgt der Rest.\n\nEs endet mit {w}.\n\nOder mit dem Xylo." for c in "AB" for w in ("Ton", "Klang", "Xylo")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    model = train_model(segment_corpus(df, "doc_id", "text"))
    new = "Die Ausf. Gamma ist neu. Es gibt ein Xylo. Mehr nicht."
    assert units(new) == ["Die Ausf.", "Gamma ist neu.", "Es gibt ein Xylo.", "Mehr nicht."]
    assert units(new, model) == ["Die Ausf. Gamma ist neu.", "Es gibt ein Xylo.", "Mehr nicht."]


def test_training_overrules_a_belief(spark):
    """A listed abbreviation that ends paragraphs as other words do is a word of this corpus."""
    from itertools import permutations

    told = ["Das war der Max.", "Danach ging er.", "Hier blieb es.", "Dort lag das Ding."]
    texts = ["\n\n".join(" ".join(p) for p in permutations(told))] * 4
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    new = "Hier kommt Max. Danach nichts."
    assert units(new) == [new]
    assert units(new, train_model(segment_corpus(df, "doc_id", "text"))) == ["Hier kommt Max.", "Danach nichts."]


def test_rare_words_share_the_counts_of_their_shape(spark):
    from genomespark.llm.sentences import event_counts

    df = spark.createDataFrame([(1, "Ein Wort. Noch eins. Ein Wort. Ein Wort. Das Haus. Der Rest.")], "doc_id long, text string")
    parts = segment_corpus(df, "doc_id", "text")
    every, few = (event_counts(parts, rare).collect() for rare in (1000, 2))
    assert sum(r.n for r in every) == sum(r.n for r in few) == 6
    assert len(few) == 3 and {(r.code if r.code >= 0 else -2 - r.code) >> 16 == 0 for r in few} == {True, False}
    assert isinstance(train_model(parts), Model)
