"""``python -m ledgerloom COMMAND``: the pipeline's steps from the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *paths: str, **options):
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        c.add_argument("--report", default="", help="folder for the step's report, as a file of JSON lines")
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v))
        return c

    add("build-dataset", "source", "target").add_argument("--splits", nargs="+", default=["train", "dev", "test"])
    add("decontaminate", "train", "target", n=8, threshold=0.5).add_argument("--held-out", nargs="+", required=True)
    add("stratified-eval", "source", "target", n=450, seed=42)
    add("facts-eval", "source", "target", n_companies=60, n_rows=180, seed=7)
    add("training-records", "source", "target", "val_target", val_fraction=0.05, seed=42, arm="cot")
    add("aggregate", "logs", out="")
    add("compare", "logs", "model", "base", arm="cot", gate_set="finqa_test", append_to="")
    add("smoke-golds", "source", n=200).add_argument("--splits", nargs="+", default=["dev"])
    return p


def main(args: list[str] | None = None) -> int:
    a = vars(parser().parse_args(args))
    from pyspark.sql import SparkSession

    from ledgerloom.operators import report
    from ledgerloom.plans import jobs

    spark, command, folder = SparkSession.builder.appName("ledgerloom").getOrCreate(), a.pop("command"), a.pop("report")
    if command == "aggregate":
        cells, pairs, text = jobs.aggregate(spark, a["logs"])
        out = a["out"]
        for df, name in ((cells, "cells"), (pairs, "pairs")) if folder else ():
            report.write_json(df, f"{folder}/{name}")
        Path(out).write_text(text) if out else print(text)
    elif command == "compare":
        path = a["append_to"]
        a["append_to"] = Path(path).read_text() if path and Path(path).exists() else ""
        text = jobs.compare(spark, **a)
        Path(path).write_text(text) if path else print(text)
    else:
        a = {k: tuple(v) if isinstance(v, list) else v for k, v in a.items()}
        got = getattr(jobs, command.replace("-", "_"))(spark, **a)
        if folder:
            report.write_json(got, folder)
        else:
            for row in report.as_json(got).collect():
                print(row.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
