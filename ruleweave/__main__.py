"""Evaluate a schema, or a rule, over JSON documents: python -m ruleweave -s SCHEMA -d DATA [-o OUT]."""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ruleweave.config import EngineConfig
from ruleweave.paths import segments
from ruleweave.plans.engine import evaluate, plain
from ruleweave.plans.schema import FormEngine, FormSchema
from ruleweave.sources.documents import read_documents, read_schema, write_documents


#: What --print-... shows of a schema.
PRINTS = {
    "sorted-evaluations": lambda s: s.batches(), "dependencies": lambda s: s.dependencies(), "tables": lambda s: {n: t.plans for n, t in s.tables.items()},
    "evaluations": lambda s: s.rules(),
}


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="ruleweave", description=__doc__)
    args.add_argument("-s", "--schema", help="schema file")
    args.add_argument("-r", "--rule", help="rule as JSON, instead of a schema")
    args.add_argument("-d", "--data", required=True, help="JSON documents, one a line")
    args.add_argument("-m", "--multiline", action="store_true", help="documents span lines")
    args.add_argument("-c", "--context", help="JSON object under $context")
    args.add_argument("-p", "--path", action="append", help="evaluate only these paths")
    args.add_argument("-o", "--output", help="folder for JSON lines; else they are printed")
    args.add_argument("--validate", action="store_true", help="give validation errors instead of values")
    args.add_argument("--offset", type=int, default=0, help="minutes from UTC of TODAY and NOW")
    args.add_argument("--compare", help="expected results, JSON lines in the order of the documents; differences are printed and end with status 1")
    args.add_argument("--compare-path", default="", help="compare only what is at this path")
    args.add_argument("-i", "--iterations", type=int, default=1, help="evaluate so often and print the times")
    args.add_argument("--no-output", action="store_true", help="evaluate, but print no results")
    for what in PRINTS:
        args.add_argument(f"--print-{what}", action="store_true", help=f"print the schema's {what.replace('-', ' ')}")
    args.add_argument("--print-all", action="store_true", help="print all that the schema holds")
    a = args.parse_args(argv)
    if a.schema:
        SparkSession.builder.getOrCreate()
        schema = FormSchema.of(read_schema(a.schema))
        for what, show in PRINTS.items():
            if a.print_all or getattr(a, f"print_{what.replace('-', '_')}"):
                print(json.dumps({what: show(schema)}, default=sorted))
    spark = SparkSession.builder.getOrCreate()
    docs = read_documents(spark, a.data, multiline=a.multiline)
    config, context = EngineConfig(timezone_minutes=a.offset), json.loads(a.context) if a.context else None
    if a.rule:
        out = evaluate(docs, {"result": json.loads(a.rule)}, context={"$context": context} if context else None, config=config)
    else:
        docs = docs.withColumn("_doc", F.monotonically_increasing_id())
        engine = FormEngine(read_schema(a.schema), docs, context=context, config=config).defaults().evaluate(a.path)
        out = engine.validate(["_doc"]) if a.validate else engine.documents()
    for n in range(a.iterations if a.iterations > 1 else 0):
        began = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        print(f"iteration {n + 1}: {time.perf_counter() - began:.3f} s", file=sys.stderr)
    if a.output:
        write_documents(out, a.output)
    elif not a.no_output:
        for row in out.toLocalIterator():
            print(json.dumps(plain(row), ensure_ascii=False))
    if a.compare and differences(spark, out, a.compare, a.compare_path):
        raise SystemExit(1)


def differences(spark: SparkSession, out, expected: str, path: str) -> int:
    """Prints each document whose result is not the expected one; how many there are."""
    wanted = [json.loads(r[0]) for r in spark.read.text(expected).toLocalIterator()]
    found, n = out.toLocalIterator(), 0
    for i, (x, want) in enumerate(itertools.zip_longest(found, wanted)):
        got = None if x is None else plain(x)
        got, want = (_at({k: v for k, v in y.items() if k != "_doc"} if isinstance(y, dict) else y, path) for y in (got, want))
        if got != want:
            n += 1
            print(json.dumps({"document": i, "expected": want, "got": got}, ensure_ascii=False))
    return n


def _at(x, path: str):
    whole = ".".join(segments(path))
    if isinstance(x, dict) and whole in x:  # fields of groups are named by their paths
        return x[whole]
    for step in segments(path):
        x = x.get(step) if isinstance(x, dict) else x[int(step)] if isinstance(x, list) and step.isdigit() and int(step) < len(x) else None
    return x


if __name__ == "__main__":
    main()
