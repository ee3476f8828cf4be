import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import answers

EXTRACTION = [
    ("Some text\nANSWER: 42", "ok", 42, 1),
    ("ANSWER: 1,234,567", "ok", 1234567, 1),
    ("ANSWER: $1,234,567", "ok", 1234567, 1),
    ("ANSWER: 37.5%", "ok", 0.375, 1),
    ("ANSWER: 37.5 percent", "ok", 0.375, 1),
    ("ANSWER: (1,234)", "ok", -1234, 1),
    ("ANSWER: −0.12%", "ok", -0.0012, 1),
    ("   answer:   7  ", "ok", 7, 1),
    ("ANSWER: `5`", "ok", 5, 1),
    ("ANSWER: 100\nANSWER: 200", "ok", 200, 2),
    ("ANSWER: 300\nANSWER:", "ok", 300, 2),
    ("ANSWER: 1,2,3", "ok", 123, 1),
    ("\n".join(["ANSWER: 8"] * 10), "ok", 8, 10),
    ("answer 42", "ok", 42, 1),
    ("ANSWER -5", "ok", 5, 1),
    ("ANSWER: -5", "ok", -5, 1),
    ("ANSWER:\n\n 9", "ok", 9, 1),
    ("ANSWER:\nANSWER: 5", "non_numeric_answer", None, 1),
    ("ANSWER:", "non_numeric_answer", None, 1),
    ("ANSWER: N/A", "non_numeric_answer", None, 1),
    ("ANSWER: 42 million", "non_numeric_answer", None, 1),
    ("ANSWER: .", "non_numeric_answer", None, 1),
    ("ANSWER: --5", "non_numeric_answer", None, 1),
    ("ANSWER: $", "non_numeric_answer", None, 1),
    ("ANSWER: —", "non_numeric_answer", None, 1),
    ("Answer is 42", "non_numeric_answer", None, 1),
    ("So the answer: 42.", "no_answer_line", None, 0),
    ("Answers: 42", "no_answer_line", None, 0),
    ("", "no_answer_line", None, 0),
    (" \n ", "no_answer_line", None, 0),
    (None, "no_answer_line", None, 0),
]
NUMBERS = [("$-5", -5), ("-$5", None), ("($5)", -5), ("$(5)", None), ("(5%)", -0.05), ("(5)%", None), ("(-5)", 5), ("+5", None), ("1,2,3", 123), ("4.9\\n", 4.9), ("$ 40444920\\n", 40444920), ("1e-05", 1e-05), ("(0.5%)", -0.005), ("€ 3", 3), ("", None), (None, None), ("1e300", 1e300), ("123456789012345678", 123456789012345678.0), ("0.1234567890123456", 0.1234567890123456)]
SCORES = [("42.0", "42", True), ("0.375", "37.5%", True), ("37.5%", "0.375", True), ("37.5", "0.375", False), ("42.459", "42.45", True), ("42.461", "42.45", False), ("1,000,500", "1000000", True), ("1,002,000", "1000000", False), ("4.9", "4.9\\n", True), ("$40444920", "$ 40444920\\n", True), ("1e-05", "1e-05", True), ("(0.5%)", "-0.005", True), ("10", "9", False), ("42.46", "42.45", True), ("1001", "1000", True), ("1001.0001", "1000", False), ("5", None, False), ("5", "junk", False), ("1e20", "1e20", True)]


def test_extraction(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(EXTRACTION)], "i int, t string")
    got = df.select("i", answers.extract_answer(F.col("t")).alias("e")).orderBy("i").collect()
    for r, (text, status, value, n) in zip(got, EXTRACTION):
        assert (r.e.status, r.e.n_answer_lines) == (status, n), text
        assert (r.e.number is None) == (value is None) and (value is None or r.e.number.approx == pytest.approx(value, rel=1e-12)), text


def test_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    for r, (text, value) in zip(df.select("i", answers.parse_number(F.col("t")).alias("n")).orderBy("i").collect(), NUMBERS):
        assert (r.n is None) == (value is None) and (value is None or r.n.approx == pytest.approx(value, rel=1e-12)), text


def test_scores(spark):
    df = spark.createDataFrame([(i, f"ANSWER: {p}", g) for i, (p, g, _) in enumerate(SCORES)], "i int, p string, g string")
    for r, case in zip(df.select("i", answers.score(F.col("p"), F.col("g")).alias("s")).orderBy("i").collect(), SCORES):
        assert r.s.correct is case[2], case


def test_select_gold(spark):
    df = spark.createDataFrame([("0.5", "50%"), ("junk", "5"), (None, ""), ("x", "y"), ("", None)], "e string, a string")
    got = [r.g for r in df.select(answers.select_gold(F.col("e"), F.col("a")).alias("g")).collect()]
    assert [(g.gold, g.gold_source, g.drop_reason) for g in got] == [("0.5", "exe_ans", None), ("5", "answer_fallback", None), (None, None, "empty_gold"), (None, None, "non_numeric_gold"), (None, None, "empty_gold")]
