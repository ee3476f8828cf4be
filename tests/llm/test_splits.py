import random
from pathlib import Path

import numpy as np

from ledgerloom import session
from ledgerloom.llm import kernel, splits

SCHEMA = "id string, split string, gold_source string, question string, context string, program string, gold string, cls int, terms string"
WORDS = [f"word{k}" for k in range(400)]


def record(i, split, q, ctx, program="", gold="0.5"):
    return (i, split, "exe_ans", q, ctx, program, gold, 0, "x")


def table(seed=0):
    rnd = random.Random(seed)
    ctx = [" ".join(rnd.sample(WORDS, 30)) + f"\nnet income | {rnd.randint(100, 9999)} | {rnd.randint(100, 9999)}" for _ in range(12)]
    rows = []
    for k in range(60):
        c = ctx[rnd.randrange(12)].split(" ")
        for _ in range(rnd.randrange(4)):
            c[rnd.randrange(len(c) - 3)] = rnd.choice(WORDS)
        q = rnd.choice(["what was the percentage change in net income from 2019 to 2020?", "by what percent did net income change between 2019 and 2020?", "what was the average net income across 2019 and 2020?"])
        rows.append(record(f"r{k}", rnd.choice(["train", "train", "dev", "test"]), q, " ".join(c)))
    return rows


def test_reading():
    k = splits.reading
    assert k("What was the percentage change in net income from 2019 to 2020?") == k("by what percent did net income change between 2019 and 2020 ?") == k("um wie viel prozent hat sich net income von 2019 bis 2020 verändert?")
    assert k("what was the change in net income from 2019 to 2020, in thousands?")[2] != k("by what percent did net income change between 2019 and 2020?")[2]
    assert k("by what percent did net income change between 2018 and 2020?")[1] == "2018 2020"
    assert k(None) == k("") == ("", "", "") and k("why?")[0] == "why"


def test_gold_value():
    assert [splits.gold_value(x) for x in ("7.06%", "(1,234)", "$5", "x", None, "-0.5\\n")] == [0.0706, -1234.0, 5.0, None, None, -0.5]


def vectors(rows):
    """The vector of every record, written out term by term."""
    import pyarrow as pa

    def terms(text, block):
        w = kernel.words(pa.array([text], pa.string()))
        own = w.hash if block >= splits.IN_CONTEXT else w.hash[w.is_number() == (block == splits._FIGURES)]
        own = own.tolist() or [0]
        return {(block, t): 1 + np.log(own.count(t)) for t in own}

    bags = []
    for r in rows:
        q = splits.reading(r[3])
        bags.append({k: v for block, text in enumerate((r[4], r[4], *q)) for k, v in terms(text, block).items()})
    reps = {(r[1] == "train", tuple(sorted(b.items())), splits.gold_value(r[6])): b for r, b in zip(rows, bags)}
    df = {}
    for b in reps.values():
        for t in b:
            df[t] = df.get(t, 0) + 1
    out = []
    for b in bags:
        v = {t: np.float32(x) * np.log1p(len(reps) / df[t]) for t, x in b.items()}
        norm = [np.sqrt(sum(x * x for (k, _), x in v.items() if k == block)) for block in range(len(splits.BLOCKS))]
        out.append({t: x / norm[t[0]] * np.sqrt(splits.SHARES[t[0]]) for t, x in v.items()})
    return out


def brute(rows, least):
    rows = [r for r in rows if r[0] is not None and r[1] in ("train", "dev", "test")]
    vec, out = vectors(rows), set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[1] == "train" and b[1] != "train":
                x, y = splits.gold_value(a[6]), splits.gold_value(b[6])
                figures = [{t for t in v if t[0] == splits._FIGURES} for v in (vec[i], vec[j])]
                same = figures[0] <= figures[1] or figures[1] <= figures[0] if x is None or y is None else abs(x - y) <= 0.001 * abs(y) + 1e-5
                if same and sum(w * vec[j].get(t, 0) for t, w in vec[i].items()) >= least:
                    out.add((a[0], b[0]))
    return out


def test_against_all_pairs(spark):
    for seed, least in ((1, 0.88), (2, 0.8), (3, 0.5)):
        rows = table(seed)
        got = {(r.train_id, r.eval_id) for r in splits.overlaps(spark.createDataFrame(rows, SCHEMA), least, cap=(1000, 20, 3)[seed - 1]).collect()}
        assert got == brute(rows, least) and got


def test_many_tables_against_all_pairs():
    """Prefixes lose no pair: 500 random tables, checked without Spark on the vectors themselves."""
    for seed in range(500):
        rows = table(seed)[:24]
        vec = vectors(rows)
        side = np.array([r[1] == "train" for r in rows])
        count = {t: (sum(t in v for v, s in zip(vec, side) if s), sum(t in v for v, s in zip(vec, side) if not s)) for v in vec for t in v}
        flat = [(i, t, w) for i, v in enumerate(vec) for t, w in sorted(v.items(), key=lambda x: (splits._ORDER[x[0][0]], sum(count[x[0]]), x[0]))]
        ids = {t: k for k, t in enumerate(sorted(count))}
        rec, terms, w = np.array([x[0] for x in flat]), np.array([ids[x[1]] for x in flat]), np.array([x[2] for x in flat])
        nt, ne, blocks = np.array([count[x[1]][0] for x in flat]), np.array([count[x[1]][1] for x in flat]), np.array([x[1][0] for x in flat])
        frequent = splits.Frequent(len(rows), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        said, asked, rest = splits.prefixes(side, terms, w, nt, ne, blocks, rec, len(rows), frequent, 0.8)
        for i in np.flatnonzero(side):
            for j in np.flatnonzero(~side):
                if sum(x * vec[j].get(t, 0) for t, x in vec[i].items()) >= 0.8:
                    shared = [set(terms[u[rec[u] == i]]) & set(terms[u[rec[u] == j]]) for u in (said, asked)]
                    assert shared[0] and shared[1]
                    product = sum(w[said][(terms[said] == t) & (rec[said] == i)][0] * w[said][(terms[said] == t) & (rec[said] == j)][0] for t in shared[0])
                    assert product + max(rest[i], rest[j]) >= 0.8 - 1e-6


def test_cases(spark):
    q, c = "what was the ratio of net income to total debt in 2020?", "the board met in june.\nnet income | 1,234 | 567\ntotal debt | 9,876 | 543\nall is well that ends."
    rows = [
        record("t1", "train", q, c), record("t2", "Train ", "for 2020, how large was net income as a share of total debt?", c.replace(",", "").upper()),
        record("d1", "dev", q, "some older figures were regrouped.\n" + c), record("d2", "dev", "what was the average net income across 2019 and 2020?", c),
        record("d3", "test", q, c.replace("1,234", "4,321").replace("567", "765").replace("9,876", "6,789").replace("543", "345"), gold="0.7"),
        record("d4", "test", "what was the ratio of total debt to net income in 2020?", c, gold="2"),
        record("t1", "train", q, c), record(None, "train", q, c), record("n1", "dev", None, None, None, None), record("n2", "train", None, None, None, None), record("o", "other", q, c),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.train_id, r.eval_id) for r in splits.overlaps(df, 0.75).collect()) == [("n2", "n1"), ("t1", "d1"), ("t2", "d1")]
    r = splits.overlap_counts(df, least=0.75).first()
    assert (r.split, r.n_pairs, r.n_eval, r.n_train) == ("dev", 3, 2, 3)
    assert splits.overlaps(df.limit(0)).count() == 0 and splits.overlap_counts(df.limit(0)).count() == 0


def test_added_words_lose_no_link(spark):
    """The only evaluation record has 30 words more than its train record: no bound may drop the pair."""
    q = "what was the ratio of net income to total debt in 2020?"
    rows = []
    for k in range(20):
        rnd = random.Random(k)
        ctx = " ".join(rnd.sample(WORDS, 60)) + f"\nnet income | {1000 + 7 * k} | 567"
        rows += [record(f"t{k}", "train", q, ctx), record(f"d{k}", "dev", q, ctx + " " + " ".join(rnd.sample(WORDS, 30)))]
    for part in (rows[:2], rows):
        got = {(r.train_id, r.eval_id) for r in splits.overlaps(spark.createDataFrame(part, SCHEMA)).collect()}
        assert got == {(f"t{k}", f"d{k}") for k in range(len(part) // 2)}


def test_the_cosine_decides(spark):
    """Programs and golds do not make a pair: the same question and answer on another page is none, another wording of the program still one."""
    rnd = random.Random(5)
    page, other = (" ".join(rnd.sample(WORDS, 60)) for _ in range(2))
    q = "what was the ratio of net income to total debt in 2020?"
    rows = [record("t1", "train", q, page, "divide(5, 10)"), record("d1", "dev", q, other, "divide(5, 10)"), record("d2", "dev", q, page + " regrouped", "divide( 5.0 ; 10.0 )")]
    assert [(r.train_id, r.eval_id) for r in splits.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()] == [("t1", "d2")]


def test_one_page_with_many_questions(spark):
    """A page that holds most records makes no long list: lists are kept by what is asked as well, and long lists are split."""
    rnd = random.Random(9)
    page = " ".join(rnd.sample(WORDS, 60))
    rows = [record(f"{s}{k}", s, f"what was the ratio of {WORDS[k]} to {WORDS[k + 1]} in 2020?", page, gold=str(k)) for k in range(0, 200, 2) for s in ("train", "dev")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(f"train{k}", f"dev{k}") for k in range(0, 200, 2)}
    assert {(r.train_id, r.eval_id) for r in splits.overlaps(df).collect()} == want
    before, splits.LIST_ROWS = splits.LIST_ROWS, 3
    try:
        assert {(r.train_id, r.eval_id) for r in splits.overlaps(df).collect()} == want
    finally:
        splits.LIST_ROWS = before


def test_copies_are_joined_once(spark):
    q, c = "what was the ratio of net income to total debt in 2020?", "net income | 1,234 | 567\ntotal debt | 9,876 | 543"
    df = spark.createDataFrame([record(f"t{k}", "train", q, c) for k in range(300)] + [record("d", "dev", q, c)], SCHEMA)
    pairs, members = splits.class_pairs(df)
    assert pairs.count() == 1 and members.count() == 301 and splits.overlaps(df).count() == 300


def test_records_without_program_and_readable_question_meet(spark):
    page = " ".join(WORDS[:50])
    q, c = "how much cash was held at year end?", page + ".\ncash | 1,234 | 567\ntotal debt | 9,876 | 543\nall is well that ends."
    other = c.replace("1,234", "4,321").replace("567", "765")
    rows = [
        record("t1", "train", q, c, None, "1234"), record("t2", "train", q, c, None, None), record("t3", "train", "what is it?", c, None, None),
        record("d1", "dev", q, c, None, "1234"), record("d2", "dev", q.upper(), "some older figures were regrouped.\n" + c, None, "1,234"),
        record("d3", "test", q, other, None, "4321"), record("d4", "test", "how much debt was held at year end?", c, None, "9876"), record("d5", "dev", "what is it?", c, None, None),
    ]
    got = sorted((r.train_id, r.eval_id) for r in splits.overlaps(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("t1", "d1"), ("t1", "d2"), ("t2", "d1"), ("t2", "d2"), ("t3", "d5")]


def moved(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_the_disk_stays_a_small_multiple_of_the_input(spark, tmp_path, monkeypatch):
    """Pages with figures in common and the same questions are many candidates, but neither they nor vectors of all records may be written or moved."""
    rnd, rows = random.Random(3), []
    for k in range(3000):
        figures = " | ".join(str(rnd.randint(1000, 1600)) for _ in range(16))
        q, s = f"what was the ratio of {WORDS[k % 5]} to {WORDS[k % 5 + 1]} in 2020?", ("train", "train", "dev")[k % 3]
        rows.append(record(f"r{k}", s, q, " ".join(rnd.sample(WORDS, 40)) + "\n" + figures, gold=None))
    rows += [record(f"c{k}", "train", *r[3:5], gold=None) for k, r in enumerate(rows[2:300:30])]
    path = str(tmp_path / "examples")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    size = sum(p.stat().st_size for p in (tmp_path / "examples").glob("*.parquet"))
    written, before, durable = [0], moved(spark), splits.durable

    def spy(df, *args, **how):
        out = durable(df, *args, **how)
        path = session._WRITTEN[-1][1].removeprefix("file://")
        written[0] += sum(p.stat().st_size for p in Path(path).glob("*.parquet"))
        return out

    monkeypatch.setattr(splits, "durable", spy)
    got = {(r.train_id, r.eval_id) for r in splits.overlaps(spark.read.parquet(path)).collect()}
    assert got == {(f"c{k}", f"r{2 + 30 * k}") for k in range(10)}
    total = moved(spark) - before + written[0]
    assert total < 4 * size, (total, size)


def test_rounds_lose_nothing(spark, monkeypatch):
    rows = table(1)
    monkeypatch.setattr(splits, "ROOM", 1)
    monkeypatch.setattr(splits, "MOVED", 0.5)
    got = {(r.train_id, r.eval_id) for r in splits.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, splits.MIN_COSINE) and got
