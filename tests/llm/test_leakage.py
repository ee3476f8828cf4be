import random

import pyarrow as pa

from ledgerloom.llm import leakage

RND = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "ti") for b in ("dor", "fen", "gat", "hil", "jun", "kol", "lim", "mos", "nar", "pel")]
ITEM = [RND.choice(WORDS) if k % 5 else str(RND.randint(1000, 99999)) for k in range(80)]


def altered(words, every, rnd):
    out = []
    for k, w in enumerate(words):
        if k % every == every // 2:
            how = rnd.randrange(3)
            out += [] if how == 0 else ["indeed"] if how == 1 else [w, "also"]
        else:
            out.append(w)
    return out


def one(text, item=None, **kw):
    index = leakage.build_index([1], [" ".join(item or ITEM)])
    return bool(leakage.probe(index, pa.array([text]), leakage.MASKS, kw.get("min_words", 20), leakage.MAX_DIFFER)[0])


def filler(n):
    return " ".join(RND.choice(WORDS) + "x" for _ in range(n))


def test_exact_and_formatted():
    part = " ".join(ITEM[10:30])
    assert one(filler(50) + " " + part + " " + filler(50))
    assert one(filler(9) + " " + part.upper().replace(" ", ",\n  ") + ". " + filler(9))
    assert one("\\n" + part.replace(" ", "\\n") + "\\t" + filler(3))
    assert not one(filler(50) + " " + " ".join(ITEM[10:26]) + " " + filler(50))


def test_single_changes_are_bridged():
    hits = sum(one(filler(30) + " " + " ".join(altered(ITEM[5:45], every, random.Random(s))) + " " + filler(30)) for every in (7, 9, 12, 15) for s in range(10))
    assert hits == 40


def test_like_wording_with_other_figures_is_no_leak():
    other = [w if not w.isdigit() else str(int(w) + 7) for w in ITEM]
    assert not one(filler(20) + " " + " ".join(other) + " " + filler(20))


def test_masks_find_each_position():
    for mask in leakage.MASKS:
        assert mask.count("1") == 6 and mask[0] == mask[-1] == "1"


def test_operator(spark):
    text = " ".join(ITEM)
    docs = spark.createDataFrame([(1, filler(20) + text, "x"), (2, None, "x"), (3, "", "x"), (4, filler(3000) + " " + " ".join(ITEM[40:62]) + " " + filler(3000), "x"), (5, filler(40), "x"), (1, text, "x"), (None, text, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, text), (8, None), (9, "too short"), (7, text), (10, " ".join(ITEM[:40]) + " " + filler(30))], "item_id long, text string")
    want = {(1, 7), (4, 7), (1, 10), (None, 7), (None, 10)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == want
    shuffled = leakage.leaks(docs, items, index_words=20)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == want and shuffled.count() == 5
    assert leakage.leaks(docs.limit(0), items, index_words=0).count() == leakage.leaks(docs, items.limit(0), index_words=-1).count() == 0
    assert leakage.leaks(docs.limit(0), items).count() == leakage.leaks(docs, items.limit(0)).count() == 0


def test_long_passages():
    for least in (40, 63, 70):
        assert one(filler(50) + " " + " ".join(ITEM[2:78]) + " " + filler(50), min_words=least)
        assert not one(filler(50) + " " + " ".join(ITEM[2 : least - 5]) + " " + filler(50), min_words=least)


def test_both_forms_agree(spark, monkeypatch):
    """The shuffled seed join finds what the index finds, also with hot seeds split."""
    rnd = random.Random(3)
    items = [(k, " ".join(rnd.choice(WORDS) if j % 6 else str(rnd.randint(100, 9999)) for j in range(60)) + (" as stated before in the notes to these accounts" if k % 2 else "")) for k in range(40)]
    docs = []
    for d in range(150):
        parts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 120))), "as stated before in the notes to these accounts"]
        for _ in range(rnd.randrange(3)):
            w = items[rnd.randrange(40)][1].split()
            at, n = rnd.randrange(40), rnd.randint(10, 40)
            parts.insert(rnd.randrange(3), " ".join(altered(w[at : at + n], rnd.choice((8, 11, 99)), rnd)))
        docs.append((d, " ".join(parts)))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {tuple(r) for r in leakage.leaks(docs, items).collect()}
    assert len(want) > 40 and {tuple(r) for r in leakage.leaks(docs, items, index_words=0).collect()} == want
    monkeypatch.setattr(leakage, "PART_ROWS", 20)
    assert {tuple(r) for r in leakage.leaks(docs, items, index_words=0).collect()} == want
