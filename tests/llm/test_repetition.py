import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import kernel, repetition


def brute(text, k):
    import re

    h = list(kernel.words(pa.array([re.sub(repetition._STEP, " ", text or "")], pa.large_string())).hash)
    seen, cov, longest = {}, set(), 0
    for i in range(len(h)):
        for j in range(i):
            n = 0
            while i + n < len(h) and h[j + n] == h[i + n]:
                n += 1
            if n >= k:
                cov.update(range(i, i + n))
                longest = max(longest, n)
    return len(h), len(cov), longest


texts = st.lists(st.one_of(st.none(), st.text("ab c.\n", max_size=60), st.lists(st.sampled_from(["it was so", "it was so", "then", "we saw 5", "the end of it all"]), max_size=12).map(" ".join)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(2, 5))
def test_brute_force(items, k):
    n, cov, longest = repetition.measure(pa.array(items, pa.string()), k)
    for i, t in enumerate(items):
        assert (n[i], cov[i], longest[i]) == brute(t, k)


def test_longest_repeat_is_exact():
    ten = "one two three four five six seven eight nine ten"
    n, cov, longest = repetition.measure(pa.array([f"{ten} one two three four {ten}", "a b c d e f a b c d x a b c d e f g a b c d e f g"]))
    assert longest.tolist() == [10, 7] and cov.tolist() == [14, 17]


def test_blocks_do_not_matter(monkeypatch):
    items = ["a b c d e a b c d e " * k for k in range(1, 30)] + ["x y z " * 400]
    whole = repetition.measure(pa.array(items))
    monkeypatch.setattr(repetition, "BLOCK_WORDS", 50)
    assert all((a == b).all() for a, b in zip(whole, repetition.measure(pa.array(items))))


def test_operator(spark):
    loop = "The sign follows from the order of the years. "
    rows = [(1, loop * 10, 1), (2, loop + "THE SIGN  follows from the order of the years!\nStep 3: the sign follows from the order of the years", 1), (3, "All words here differ from one another.", 1), (4, None, None), (5, "", 0), (6, loop + "Nothing else is said twice in this rather long text of ours at all.", 1), (6, loop * 9, 2)]
    df = spark.createDataFrame(rows, "row_id long, output string, repeat_share int")
    got = repetition.repetition(df, "output", ("row_id",)).collect()
    assert len(got) == 7 and {r.row_id for r in repetition.repetitive(df, "output", ("row_id",)).collect()} == {1, 2, 6}
    assert next(r for r in got if r.row_id == 1).repeat_words == 81 and next(r for r in got if r.row_id == 1).longest_repeat == 81
    assert all(r.repeat_share == 0 for r in got if r.row_id in (3, 4, 5))
    assert {r.row_id for r in repetition.repetitive(df, "output", ("row_id",), min_share=2.0, min_longest=81).collect()} == {r.row_id for r in got if r.longest_repeat >= 81} == {1}
    assert repetition.repetition(df.limit(0), "output", ("row_id",)).count() == 0


def test_han_signs_count_as_words():
    n, cov, _ = repetition.measure(pa.array(["首先读取两个数值。首先读取两个数值。首先读取两个数值。"]))
    assert n[0] == 24 and cov[0] == 16


def test_words():
    w = kernel.words(pa.array(["Net Income, 1,234.5\\nIt's", None, "", "net income", "ÄRGER ärger", "x" * 5000 + " " + "x" * 5000]))
    assert [w.text(i) for i in range(8)] == ["net", "income", "1234", "5", "it", "s", "net", "income"]
    assert w.hash[0] == w.hash[6] and w.hash[8] == w.hash[9] and w.hash[10] == w.hash[11] and len(np.unique(w.hash)) == 8
    assert w.row.tolist() == [0] * 6 + [3] * 2 + [4] * 2 + [5] * 2
