import random

from genomespark.llm.leaks import proximity_matches, shared_passages, words
from tests.helpers import rows


def brute(docs, items, n=20):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    g = {k: grams(t) for k, t in items}
    return sorted((d, k) for d, t in docs for h in [grams(t)] for k, s in g.items() if h & s)


def test_words():
    assert words("The co-\noperative ＡＢＣ １２! soft­hy, x_y") == ["the", "cooperative", "abc", "12", "softhy", "x", "y"]
    assert words("漢字かなﾃｽﾄabc한국어") == ["漢", "字", "か", "な", "テ", "ス", "ト", "abc한국어"]
    assert words("well-known A-\r\nB") == ["well", "known", "ab"]
    assert words(None) == words("") == []


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "漢", "字"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([5, 19, 20, 21, 45])))) for i in range(25)] + [(90, None), (91, ""), (92, "the " * 40), (None, "a " * 30)]
    docs = []
    for d in range(120):
        text = " ".join(r.choices(vocab + ["zz", "yy"], k=r.randrange(0, 80)))
        if r.random() < 0.6:
            w = words(items[r.randrange(25)][1])
            a = r.randrange(0, max(1, len(w) - 15))
            text += r.choice([". ", " ", "\n\n"]) + r.choice([" ", ", ", "*\n*"]).join(x.upper() if r.random() < 0.3 else x for x in w[a : a + r.choice([19, 20, 30])]) + " zz " + text[:40]
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "the " * 60), (503, docs[3][1])]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, term string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = shared_passages(d, i)
    want = brute(docs, [x for x in items if x[0] is not None])
    assert sorted(rows(got.select("doc_id", "item_id"))) == want and want
    assert got.where("longest < 20 OR n_words < longest").count() == 0
    assert shared_passages(d, i.limit(0)).count() == 0 and shared_passages(d.limit(0), i).count() == 0


def test_long_document_of_repeated_words(spark):
    docs = spark.createDataFrame([(1, "the " * 30_000), (2, "the " * 19)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the " * 25), (8, "of " * 25)], "item_id long, text string")
    assert rows(shared_passages(docs, items)) == [(1, 7, 25, 25)]


def brute_near(docs, items, least=20, span=25):
    out = []
    for d, t in docs:
        w = words(t)
        for k, u in items:
            v = words(u)
            best = 0
            for shift in range(-len(v) + 1, len(w)):
                hit = [0 <= shift + i < len(w) and w[shift + i] == x for i, x in enumerate(v)]
                best = max(best, *(sum(hit[i : i + span]) for i in range(len(hit))), 0) if hit else best
            if best >= least:
                out.append((d, k, best))
    return sorted(out)


def test_proximity_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([5, 19, 20, 22, 25, 40])))) for i in range(20)] + [(90, None), (91, "the " * 30)]
    docs = []
    for d in range(80):
        w = words(items[r.randrange(20)][1])
        a = r.randrange(0, max(1, len(w) - 20))
        part = w[a : a + r.choice([20, 25, 30])]
        for i in r.sample(range(len(part)), min(len(part), r.choice([0, 1, 3, 5, 6, 8]))):
            part[i] = r.choice(["zz", "yy", *vocab])
        docs.append((d, " ".join([*r.choices([*vocab, "zz"], k=r.randrange(20)), *part, *r.choices(["zz", "of"], k=r.randrange(8))])))
    docs += [(500, None), (501, ""), (502, "the " * 22), (503, docs[3][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_near(docs, items)
    assert sorted(rows(proximity_matches(d, i))) == want
    exact = {tuple(x) for x in shared_passages(d, i).select("doc_id", "item_id").collect()}
    assert exact < {x[:2] for x in want}
    assert proximity_matches(d, i.limit(0)).count() == 0 and proximity_matches(d.limit(0), i).count() == 0
