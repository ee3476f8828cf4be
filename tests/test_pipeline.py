import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import prompts
from ledgerloom.operators import decontam, facts, report, runlog, sampling, stats, training
from ledgerloom.plans import jobs
from ledgerloom.sources import jsonl, raw
from ledgerloom.streaming import runlog as stream

GOLDEN = [(63, 50, 0.25886200016531563), (104, 25, 1.1955847474890754e-12), (97, 31, 4.155995426933083e-09), (253, 49, 2.6850339040772086e-34), (71, 28, 1.8257600947585227e-05), (43, 16, 0.0005843646280443461), (35, 51, 0.10522535125694396), (0, 0, 1.0), (4, 4, 1.0), (1, 0, 1.0), (0, 9, 2 / 2**9)]


def test_mcnemar(spark):
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(GOLDEN)], "i int, b int, c int")
    got = [r.p for r in df.select("i", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx([p for *_, p in GOLDEN], rel=1e-11)


def test_interval_is_the_binomial_quantile(spark):
    cases = [(450, 283), (1127, 739), (180, 132), (10, 0), (10, 10), (1, 1), (7, 3), (100_000, 3)]
    df = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(cases)], "i int, n int, k int")
    got = df.select("i", stats.binomial_interval(F.col("n"), F.col("k")).alias("c")).orderBy("i").collect()
    for (n, k), r in zip(cases, got):
        want, cdf = [], 0.0
        for i in range(min(n, k + 400) + 1):
            p = k / n
            cdf += float(i == k) if p in (0, 1) else math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
            want += [i / n] * sum(cdf >= q - 1e-12 for q in (0.025, 0.975)[len(want) :])
        assert (r.c.lo, r.c.hi) == pytest.approx(tuple(want)), (n, k)
    assert (round(got[1].c.lo, 4), round(got[1].c.hi, 4)) == (0.6282, 0.6832)


def test_pairs_cells_gates(spark):
    log = spark.createDataFrame([("m", "a", "e", "1", True, "ok"), ("m", "b", "e", "1", False, "ok"), ("m", "a", "e", "2", False, "ok"), ("m", "b", "e", "2", False, "no_answer_line"), ("m", "c", "e", "1", True, "ok"), ("n", "a", "e", "1", False, "ok"), ("n", "a", "e", "9", True, "ok")], "model string, arm string, eval_set string, id string, correct boolean, status string")
    got = {(r.arm_a, r.arm_b): (r.b, r.c, r.n_shared) for r in stats.arm_pairs(log).collect()}
    assert got == {("a", "b"): (1, 0, 2), ("a", "c"): (0, 0, 1), ("b", "c"): (0, 1, 1)}
    r = stats.compare_models(log, "m", "n", "a").first()
    assert (r.n, r.only_a, r.only_b, r.b, r.c, r.delta_points, r.gate) == (1, 1, 1, 1, 0, 100.0, "PASS")
    assert stats.cells(log.where("model = 'm' and arm = 'a'")).first().acc == 0.5
    assert stats.cells(log.limit(0)).count() == stats.arm_pairs(log.limit(0)).count() == 0
    g = spark.createDataFrame([(4.0, True), (4.0, False), (2.0, False), (0.5, True)], "d double, a boolean")
    assert [x.p for x in g.select(stats.phase1(F.col("d"), F.col("a")).alias("p")).collect()] == ["pass", "unclassified", "partial", "fail"]


def test_containment(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    held = spark.createDataFrame([("e", words, None)], "id string, question string, context string")
    half = words.split()[:9] + ["x"] * 1 + ["y"]
    train = spark.createDataFrame([("same", words, words), ("short", "one two three", ""), ("null", None, None), ("none", "a b c d e f g h i", words + " " + words), ("part", " ".join(half), "")], "id string, question string, context string")
    got = {r.id: (r.question_overlap, r.context_overlap) for r in decontam.decontaminate(train, held).collect()}
    assert got["same"] == (1.0, 1.0) and got["short"] == got["null"] == (0.0, 0.0) and got["none"][0] == 0.0 and 0 < got["none"][1] < 1
    assert got["part"][0] == 0.5
    assert sorted(r.id for r in decontam.kept(train, decontam.decontaminate(train, held)).collect()) == ["none", "null", "short"]
    assert decontam.decontaminate(train.limit(0), held).count() == 0
    assert decontam.report(decontam.decontaminate(train, held)).first().n_dropped == 2


def test_sampling(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as id", "if(id < 700, 'a', if(id < 995, 'b', 'c')) as s", "id as v")
    got = sampling.stratified(df, ("s",), "id", 100)
    counts = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert sum(counts.values()) == 100 and counts["c"] >= 1 and abs(counts["a"] - 70) <= 1
    assert {r.id for r in got.collect()} == {r.id for r in sampling.stratified(df.repartition(7), ("s",), "id", 100).collect()}
    split = sampling.seeded_split(df, "id", 0.05)
    assert split.where("part = 'val'").count() == 50 and split.count() == 1000
    bins = sampling.quartile(spark.createDataFrame([(x,) for x in (1, 1, 1, 2, 3, 4, None)], "v int"), F.col("v"), "q")
    assert [r.q for r in bins.orderBy("v").collect()] == [None, 0, 0, 0, 2, 3, 3]
    assert sampling.stratified(df, ("s",), "id", 5000).count() == 1000


def test_facts(spark):
    entry = lambda **k: {"start": "2025-12-01", "end": "2026-02-28", "val": 1.0, "form": "10-Q", "filed": "2026-03-01", "frame": "CY2026Q1"} | k
    docs = spark.createDataFrame(
        [
            (1, "A", {"us-gaap": {"Assets": {"units": {"USD": [entry(val=100.0), entry(end="2026-05-31", val=150.0), entry(end="2026-05-31", val=150.0, filed="2026-09-01"), entry(end="2026-08-31", val=150.0, form="8-K")]}}, "CashAndCashEquivalentsAtCarryingValue": {"units": {"USD": [entry(val=25.0), entry(val=30.0, start=None)]}}}}),
            (2, "B", {}),
            (3, "C", None),
        ],
        "cik_str long, title string, facts map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,form:string,filed:string,frame:string>>>>>>",
    )
    rows = facts.entries(docs)
    c = facts.changes(rows).collect()
    assert [(r.program, r.gold, r.filed) for r in c] == [("subtract(150, 100), divide(#0, 100)", 0.5, "2026-09-01")]
    assert [(r.program, r.gold) for r in facts.portions(rows).collect()] == [("divide(25, 100)", 0.25)]
    table = facts.build_eval(docs)
    assert sorted(r.id for r in table.collect()) == ["facts-0", "facts-1"]
    run = training.dispositions(table.select("*")).select("disposition").collect()
    assert {r.disposition for r in run} == {"kept"}


def test_training(spark):
    df = spark.createDataFrame([("1", "q", "c", "add(1, 2)", "3"), ("2", "q", "c", "add(1, 2)", "9"), ("3", "q", "c", "table_max(a, b)", "3"), ("4", "q", "c", "add(1, y)", "3"), ("5", "q", "c", "add(1, 2)", "300%"), ("6", None, None, None, None)], "id string, question string, context string, program string, gold string")
    got = {r.id: r.disposition for r in training.dispositions(df).collect()}
    assert got == {"1": "kept", "2": "mismatch", "3": "table_op", "4": "parse_error", "5": "parse_error", "6": "parse_error"}
    rec = training.records(training.dispositions(df)).collect()
    assert len(rec) == 1 and rec[0].messages[1].content == "Step 1: take 1 plus 2; that is 3 (#0).\nProgram: add(1, 2)\nANSWER: 3"
    v = spark.createDataFrame([(x,) for x in range(1, 11)], "v int")
    assert {r.share: r.value for r in training.index_percentiles(v, F.col("v")).collect()} == {0.5: 6, 0.9: 10, 0.95: 10, 0.99: 10}


def test_prompts(spark):
    df = spark.createDataFrame([("what {x}?", "ctx {question}")], "q string, c string")
    for arm in prompts.ARMS:
        t = df.select(prompts.render_prompt(arm, F.col("q"), F.col("c"), "SHOWN").alias("p")).first().p
        assert "what {x}?" in t and "ctx {question}" in t and "ANSWER:" in t and ("SHOWN" in t) == (arm == "few_shot")
    with pytest.raises(KeyError):
        prompts.render_prompt("other", F.col("q"), F.col("c"))


def test_runlog(spark, tmp_path):
    log = spark.createDataFrame([(1, "m", "a", "e", "x", True, 0.5), (2, "m", "a", "e", "x", False, None), (3, "m", "a", "e", "y", False, 0.25)], "row_id long, model string, arm string, eval_set string, id string, correct boolean, cost_usd double")
    assert sorted(r.row_id for r in runlog.first_writes(log).collect()) == [1, 3]
    assert [r.cost_so_far for r in runlog.running(log, "row_id", ("model",)).orderBy("row_id").collect()] == [0.5, 0.5, 0.75]
    ex = spark.createDataFrame([("x",), ("z",)], "id string")
    assert [r.id for r in runlog.todo(ex, log).collect()] == ["z"]
    tries = []

    def flaky(p):
        tries.append(1)
        if len(tries) < 3:
            raise runlog.CallError("busy", 429) if len(tries) == 1 else runlog.RetryableError
        return ["ok"] * len(p)

    assert runlog.with_retries(flaky, sleep=lambda s: None)(["a"]) == ["ok"]

    def refused(p):
        tries.append(1)
        raise runlog.CallError("not allowed", 403)

    tries.clear()
    with pytest.raises(runlog.CallError):
        runlog.with_retries(refused, sleep=lambda s: None)(["a"])
    assert len(tries) == 1
    out = runlog.complete(ex.withColumn("prompt", F.lit("hi")), "prompt", lambda p: [x.upper() for x in p]).collect()
    assert {r.output for r in out} == {"HI"}


def test_raw_and_jsonl(spark, tmp_path):
    items = [
        {"pre_text": ["a", " ", "b\\n c"], "post_text": ["d"], "table": [["x", "1"], ["", ""], ["y", None]], "qa": {"question": " q ", "program": "add(1, 2)", "exe_ans": 3, "answer": "3"}},
        {"qa": {"question": "q2", "exe_ans": "yes", "answer": "12%"}},
        {"pre_text": [], "table": [], "qa": {"question": "q3", "exe_ans": "", "answer": None}},
    ]
    (tmp_path / "dev.json").write_text(json.dumps(items))
    got = raw.build_examples(raw.read_raw(spark, str(tmp_path / "dev.json")), "dev").orderBy("id").collect()
    assert [(r.id, r.gold, r.gold_source, r.drop_reason) for r in got] == [("dev-0", "3", "exe_ans", None), ("dev-1", "12%", "answer_fallback", None), ("dev-2", None, None, "empty_gold")]
    assert got[0].context == "a b c\nx | 1\ny | None\nd" and got[1].program == "" and got[2].context == ""
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"\n{"x": 3}\n{"id": 4}\n')
    assert sorted(r.id for r in jsonl.done_ids(spark, str(path)).collect()) == ["1", "4"]
    with pytest.raises(Exception):
        jsonl.done_ids(spark, str(path), strict=True).collect()
    assert jsonl.done_ids(spark, str(tmp_path / "none")).count() == 0


def test_report():
    once = report.upsert_section("# Head\n", "gate", "one")
    assert report.upsert_section(once, "gate", "one") == once
    assert "two" in report.upsert_section(once, "gate", "two") and "one" not in report.upsert_section(once, "gate", "two")


def test_stream(spark, tmp_path):
    schema = "row_id long, id string, model string, arm string, eval_set string, ts timestamp, output string, gold string"
    one = spark.sql("select 1L row_id, 'a' id, 'm' model, 'c' arm, 'e' eval_set, timestamp'2026-01-01' ts, 'ANSWER: 5' output, '5' gold union all select 2L, 'A', 'm', 'c', 'e', timestamp'2026-01-02', 'x', '5'")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    one.write.parquet(src)
    stream.score_stream(spark, src, one.schema, out, ck)
    stream.score_stream(spark, src, one.schema, out, ck)
    assert [(r.row_id, r.correct) for r in spark.read.parquet(out).collect()] == [(1, True)]
    one.withColumn("row_id", F.col("row_id") + 10).write.mode("append").parquet(src)
    stream.score_stream(spark, src, one.schema, out, ck)
    assert spark.read.parquet(out).count() == 1
    assert schema


def test_stream_without_redelivery_keeps_null_and_late_ts(spark, tmp_path):
    schema = "row_id long, id string, model string, arm string, eval_set string, ts timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    one = spark.sql("select 1L row_id, 'a' id, 'm' model, 'c' arm, 'e' eval_set, timestamp'2026-03-01' ts union all select 2L, 'none', 'm', 'c', 'e', null union all select 3L, 'A ', 'M', 'c', 'e', timestamp'2026-02-01'")
    late = spark.sql("select 4L row_id, 'late' id, 'm' model, 'c' arm, 'e' eval_set, timestamp'2026-01-01' ts union all select 5L, 'None', 'm', 'c', 'e', null union all select 6L, 'a', 'm', 'c', 'e', timestamp'2026-04-01' union all select 7L, null, 'm', 'c', 'e', null")
    for batch, want in ((one, [2, 3]), (late, [2, 3, 4, 7]), (late, [2, 3, 4, 7])):
        batch.coalesce(1).write.mode("append").parquet(src)
        stream.without_redelivery(stream.read_stream(spark, src, schema), out, ck)
        assert sorted(r.row_id for r in spark.read.parquet(out).collect()) == want


def test_gate_report_of_too_many_sets_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(report, "MOST_ROWS", 2)
    cols = "n, 0.5D acc_a, 0.4D lo_a, 0.6D hi_a, 0.5D acc_b, 0.4D lo_b, 0.6D hi_b, 0D delta_points, 1 b, 1 c, 1D p, 'no' gate, 'no' phase1, 0 only_a, 0 only_b"
    sets = spark.range(3).selectExpr("concat('s', id) eval_set", *[f"{c.strip()}" if " " in c.strip() else "1 n" for c in cols.split(",")])
    assert "s1" in report.gate_report(sets.where("eval_set < 's2'"), "a", "b", "s1")
    with pytest.raises(ValueError):
        report.gate_report(sets, "a", "b", "s2")


#: Published cells: n, right answers, and the interval by 10,000 resamples of seed 0.
PUBLISHED = [(450, 0.6289, 0.5844, 0.6733), (1127, 0.6557, 0.6282, 0.6832), (180, 0.7333, 0.6667, 0.7944), (450, 0.6, 0.5533, 0.6444), (180, 0.4944, 0.4222, 0.5667), (450, 0.4533, 0.4088, 0.5), (1127, 0.4747, 0.4454, 0.504), (180, 0.5833, 0.5111, 0.6556)]


def test_resampled_intervals_are_the_published_ones():
    """The draw does not know which answers were right, so each end may be one answer beside the published one."""
    for n, acc, lo, hi in PUBLISHED:
        flags = np.zeros(n, bool)
        flags[np.random.default_rng(1).permutation(n)[: round(acc * n)]] = True
        got = stats.resampled_interval(flags, 10_000, 0)
        assert abs(got[0] - lo) <= 1.01 / n + 1e-4 and abs(got[1] - hi) <= 1.01 / n + 1e-4


def test_bootstrap_reads_rows_in_their_order(spark):
    df = spark.range(90).selectExpr("id as row_id", "'m' as model", "id % 3 = 0 as correct").repartition(7)
    r = stats.bootstrap(df, ("model",), resamples=500).first()
    assert (r.n, r.ci_lo, r.ci_hi) == (90, *stats.resampled_interval(np.arange(90) % 3 == 0, 500, 0))


def test_lines_of_a_file_read_in_several_parts_keep_their_order(spark, tmp_path):
    """The first write wins, whichever part of the file a task reads."""
    rows = [json.dumps({"id": str(k % 500), "model": "m", "arm": "a", "eval_set": "e", "correct": k < 500, "status": "ok"}) for k in range(20_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    items = [json.dumps({"pre_text": ["a"], "qa": {"question": f"q {k}", "exe_ans": str(k)}}) for k in range(5_000)]
    (tmp_path / "raw.json").write_text("\n".join(items) + "\nnot json\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        log = jobs.read_logs(spark, str(tmp_path / "a.jsonl"))
        assert jsonl.read_log(spark, str(tmp_path / "a.jsonl"), "id string").rdd.getNumPartitions() > 4
        assert log.count() == 500 and log.where("correct").count() == 500
        got = raw.read_raw_lines(spark, str(tmp_path / "raw.json")).select("pos", "qa.question").collect()
        assert len(got) == 5_000 and all(r.question == f"q {r.pos}" for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_keys_in_normal_form(spark):
    log = spark.createDataFrame([(1, " A ", "x/y.z", "CoT", "e", True), (2, "a", "x--y-z", "cot", "E", False)], "row_id long, id string, model string, arm string, eval_set string, correct boolean")
    assert [r.row_id for r in runlog.first_writes(runlog.normalized(log)).collect()] == [1]


def test_universe_and_missing_folders(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "AB", "title": "A B Inc."}, "x": {"cik_str": 5, "ticker": "C", "title": "C"}, "2": {"ticker": "D"}}))
    assert [(r.cik, r.ticker, r.file) for r in jsonl.universe(spark, str(tmp_path / "t.json")).orderBy("pos").collect()] == [(320193, "AB", "CIK0000320193.json"), (5, "C", "CIK0000000005.json")]
    assert jsonl.facts_dir(spark, str(tmp_path / "none")).count() == 0


def test_report_file_and_lengths_by_a_tokenizer(spark, tmp_path):
    rows = spark.createDataFrame([("1", [("user", "a b c"), ("assistant", "d")]), ("2", [("user", None)])], "id string, messages array<struct<role:string,content:string>>")
    sized = training.token_lengths(rows, lambda texts: [len(t.split()) for t in texts], 1)
    assert {r.id: r.n_tokens for r in sized.collect()} == {"1": 4, "2": 0}
    report.write_json(sized.select("id", "n_tokens"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
