import json

import pytest

from ledgerloom.__main__ import main
from ledgerloom.plans import jobs
from ledgerloom.sources.datasets import Datasets


def item(q, program, gold, k):
    return {"pre_text": [f"the report of unit {k} says that sales rose in the {k}th quarter of the year"], "table": [["sales", "5", "7"]], "post_text": [], "qa": {"question": q, "program": program, "exe_ans": gold, "answer": str(gold)}}


def test_from_raw_to_training(spark, tmp_path):
    d = str(tmp_path)
    words = "what was the change in sales between the first and the second quarter of the year"
    data = {"train": [item(f"{words} {k}", "subtract(7, 5)", 2, k) for k in range(20)] + [item("bad", "add(x, 1)", "yes", 99)], "dev": [item(words, "subtract(7, 5)", 2, 500)], "test": [item("short", "add(1, 1)", 3, 600)]}
    for split, rows in data.items():
        (tmp_path / f"{split}.json").write_text(json.dumps(rows))
    rep = {r.split: (r.n_raw, r.n_kept) for r in jobs.build_dataset(spark, d, f"{d}/out").collect()}
    assert rep == {"train": (21, 20), "dev": (1, 1), "test": (1, 1)}
    r = jobs.decontaminate(spark, f"{d}/out/train", (f"{d}/out/dev", f"{d}/out/test"), f"{d}/clean").first()
    assert (r.n_rows, r.n_dropped) == (20, 20)
    r = jobs.decontaminate(spark, f"{d}/out/train", (f"{d}/out/test",), f"{d}/clean").first()
    assert r.n_dropped == 0 and spark.read.parquet(f"{d}/clean").count() == 20
    got = jobs.training_records(spark, f"{d}/clean", f"{d}/sft", f"{d}/val", 0.1).collect()
    assert [(x.disposition, x.n_rows) for x in got] == [("kept", 20)]
    assert spark.read.json(f"{d}/sft").count() == 18 and spark.read.json(f"{d}/val").count() == 2
    assert jobs.stratified_eval(spark, f"{d}/clean", f"{d}/eval", 7).first().sample_share == 1.0
    assert spark.read.parquet(f"{d}/eval").count() == 7
    assert jobs.smoke_golds(spark, d, ("dev", "test")).count() == 0
    sets = Datasets(spark, {"clean": f"{d}/clean"})
    sets.views()
    assert spark.table("clean").count() == 20 and sets.head("clean", 3, "id").count() == 3
    with pytest.raises(KeyError):
        sets.load("none")


def test_logs(spark, tmp_path, capsys):
    logs = tmp_path / "logs"
    logs.mkdir()
    line = lambda i, m, ok: json.dumps({"id": i, "model": m, "arm": "cot", "eval_set": "finqa_test", "correct": ok, "status": "ok"})
    (logs / "a.jsonl").write_text("\n".join([line("1", "m", True), line("1", "m", False), "", line("2", "m", True)]))
    (logs / "b.jsonl").write_text("\n".join([line("1", "n", False), line("2", "n", False), line("3", "n", True), line("2", "m", False)]))
    cells, _, text = jobs.aggregate(spark, f"{logs}/*.jsonl")
    assert {r.model: (r.n, r.acc) for r in cells.collect()} == {"m": (2, 1.0), "n": (3, 0.3333)} and "| m | cot |" in text
    assert main(["aggregate", f"{logs}/*.jsonl", "--out", str(tmp_path / "cells.md"), "--report", str(tmp_path / "report")]) == 0
    assert spark.read.json(str(tmp_path / "report" / "cells")).count() == 2
    target = tmp_path / "gate.md"
    for _ in range(2):
        assert main(["compare", f"{logs}/*.jsonl", "m", "n", "--append-to", str(target)]) == 0
    body = target.read_text()
    assert body.count("gate: PASS") == 1 and "warning: finqa_test has 0 ids of m only and 1 of n only" in body


def test_facts_job(spark, tmp_path):
    entry = lambda end, val: {"start": "2025-12-01", "end": end, "val": val, "form": "10-Q", "filed": "2026-06-01", "frame": "CY2026Q1"}
    doc = {"cik": 5, "entityName": "A Corp.", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry("2026-02-28", 100), entry("2026-05-31", 125)]}}}}}
    (tmp_path / "CIK0000000005.json").write_text(json.dumps(doc))
    (tmp_path / "CIK0000000006.json").write_text("not json")
    r = jobs.facts_eval(spark, f"{tmp_path}/CIK*.json", f"{tmp_path}/out").first()
    assert (r.n_rows, r.n_companies, r.first_filed) == (1, 1, "2026-06-01")
