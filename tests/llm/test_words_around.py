from genomespark.llm.sentences import SURE, Model, Splitter, event_code, join_segments, next_code, segment_corpus, sentence_units, train_model


def cut_texts(df, texts, doc_ids):
    found = {}
    for r in sentence_units(df, "doc_id", "text").collect():
        if r.doc_id in doc_ids:
            found.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    return [[texts[i][a:b] for a, b in sorted(found[i])] for i in doc_ids]


def test_the_word_after_the_mark_decides(spark):
    """ "etc." may end a sentence or not, before capitals both: the words that begin sentences tell which."""
    begins = ["Danach", "Hier", "Dort"]
    texts = [f"{w} liegt Stahl Meier und Holz Becker am Ort. {v} steht Glas Meier und Blech Becker am Ort.\n\n{v} ist es der Ort." for w in begins for v in begins] * 20
    texts += [f"{w} liegt Stahl etc. {v} ist es der Ort.\n\n{w} liegt Stahl etc." for w in begins for v in begins] * 2
    texts += ["Dort liegt Stahl, Ton etc. Hier bleibt Glas.", "Dort liegt Stahl, Ton etc. Becker und Glas."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert cut_texts(df, texts, [len(texts) - 2, len(texts) - 1]) == [["Dort liegt Stahl, Ton etc.", "Hier bleibt Glas."], ["Dort liegt Stahl, Ton etc. Becker und Glas."]]


def test_two_words_before_the_mark_count(spark):
    """ "quon" goes on after "siehe" and ends sentences elsewhere; what follows here says nothing."""
    texts = ["Es gilt siehe quon. 5 und mehr, siehe quon. teils auch, siehe quon. und so fort.\n\nHier endet der quon. Danach folgt es. Hier endet der quon. Dort folgt es.\n\nEs bleibt der quon."] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train_model(segment_corpus(df, "doc_id", "text"))
    code = lambda before: Splitter().events(f"Es {before} quon. “")
    odds = {b: [model.of(c, x, p) for c, x, p in zip(*code(b)[2:]) if c >= 0] for b in ("siehe", "der")}
    assert odds["siehe"][0] < odds["der"][0] - 1


def test_a_certain_boundary_is_part_of_the_chain():
    """A short part after a certain boundary is as unlikely a unit as one after a guess."""
    guess = event_code(("Teil", "der"), "cap")
    model = Model({guess: 1.0}, alone=0.05)
    assert join_segments([0, 10, 14], [9, 13, 40], [SURE, guess, SURE], model) == [(0, 9), (10, 40)]
    assert join_segments([0, 10, 20], [9, 19, 40], [SURE, guess, SURE], model) == [(0, 9), (10, 19), (20, 40)]
    assert join_segments([0, 10, 36], [9, 35, 40], [SURE, guess, SURE], model) == [(0, 9), (10, 40)]


def test_numbers_count_by_the_word_behind_them():
    text = "Es endet hier. 634 °C gilt. 12 bar gilt. 3 gilt. 0.5 wt. % gilt."
    starts, _, _, nexts, _ = Splitter().events(text)
    after = {text[a : a + 2]: x for a, x in zip(starts[1:], nexts)}
    assert after["63"] == after["12"] == after["0."] != after["3 "] and next_code("Über") == next_code("“Über,") != next_code("über")
