"""Command line: build, audit, check, sample, publish, run and score question sets."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import render as R
from ledgerlark.operators import audit as A
from ledgerlark.operators import build as B
from ledgerlark.operators import evaluate as E
from ledgerlark.operators import runs
from ledgerlark.operators import validate as V
from ledgerlark.schema import REGIMES, SUBTASKS
from ledgerlark.ship import by_value
from ledgerlark.sources import collect as C
from ledgerlark.sources import io


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerlark")
    out.add_argument("-v", "--verbose", action="store_true")
    sub = out.add_subparsers(dest="command", required=True)
    ev = sub.add_parser("evaluate", help="score predictions")
    ev.add_argument("-s", "--subtask", choices=SUBTASKS)
    ev.add_argument("-p", "--predictions", required=True)
    ev.add_argument("-d", "--data", required=True)
    ev.add_argument("-m", "--mode", choices=E.MODES, default="numerical")
    ev.add_argument("-o", "--output")
    ins = sub.add_parser("inspect", help="show questions")
    ins.add_argument("-s", "--subtask", choices=SUBTASKS)
    ins.add_argument("-d", "--data", required=True)
    ins.add_argument("-n", "--limit", type=int, default=5)
    ins.add_argument("-j", "--json", action="store_true")
    co = sub.add_parser("collect", help="ask a client for the annual filings of companies; what is stored is not asked for again")
    co.add_argument("-c", "--companies", required=True, help="JSON array or lines with edinet_code, name, industry, gaap")
    co.add_argument("--client", required=True, help="module:function that makes a client")
    co.add_argument("--years", nargs="+", required=True)
    co.add_argument("--data-dir", required=True)
    co.add_argument("--parallel", type=int, default=1, help="companies asked for at a time")
    co.add_argument("--pause", type=float, default=1.0, help="seconds after each request")
    bu = sub.add_parser("build", help="raw filings to a final set, stage by stage")
    bu.add_argument("--stage", choices=(*B.STAGES, "all"), default="all")
    bu.add_argument("--data-dir", required=True)
    au = sub.add_parser("audit", help="audit a question file: reports as JSON and Markdown, all findings as JSON lines")
    au.add_argument("-d", "--data", required=True)
    au.add_argument("-o", "--output", required=True)
    it = sub.add_parser("integrity", help="check raw filing files")
    it.add_argument("-d", "--data", required=True)
    li = sub.add_parser("lite", help="a small stratified sample with its manifest")
    li.add_argument("-d", "--data", required=True)
    li.add_argument("-o", "--output", required=True)
    li.add_argument("--seed", type=int, default=42)
    pu = sub.add_parser("publish", help="a final set as flat tables, one configuration a subtask")
    pu.add_argument("-d", "--data", required=True)
    pu.add_argument("-o", "--output", required=True)
    ru = sub.add_parser("run", help="ask a model, going on where a stored run ended")
    ru.add_argument("--model", required=True)
    ru.add_argument("--regime", required=True, choices=tuple(REGIMES))
    ru.add_argument("--provider", required=True, help="module:function of (model, system, prompt, settings)")
    ru.add_argument("-d", "--data", required=True)
    ru.add_argument("-n", "--limit", type=int, default=0)
    ru.add_argument("-o", "--out-dir", required=True)
    ru.add_argument("--parallel", type=int, default=1, help="questions asked at a time")
    return out


def json_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds JSON files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(io.current(spark, path))
    return any(f.getPath().getName().endswith(".json") for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def load(spark: SparkSession, path: str, subtask: str | None):
    """Nested questions from JSON or JSON lines (a file or a folder of them), else from a published set."""
    return io.load_file(spark, path, subtask) if path.endswith((".json", ".jsonl")) or json_files(spark, path) else io.unflatten(io.load_table(spark, path, subtask))


def listing(questions, limit: int) -> list[str]:
    """Lines that show the first questions."""
    return [line for r in shown(questions).limit(limit).collect() for line in r["lines"]]


def shown(questions):
    """``id, lines``: how each question is shown."""
    size = F.concat(F.lit("Table: "), F.size("table.rows").cast("string"), F.lit(" rows x "), F.size("table.headers").cast("string"), F.lit(" cols"))
    lines = F.array(
        F.lit("=" * 60), F.concat(F.lit("ID: "), "id", F.lit("  |  Subtask: "), "subtask"), F.concat(F.lit("Question: "), "qa.question"), F.concat(F.lit("Answer: "), "qa.answer"),
        F.when(F.size("qa.program") > 0, F.concat(F.lit("Program: "), F.array_join("qa.program", " → "))), size,
        F.when(F.coalesce("edinet_code", F.lit("")) != "", F.concat(F.lit("Source: "), "edinet_code", F.lit(" ("), F.coalesce("filing_year", F.lit("None")), F.lit(")"))), F.lit(""),
    )
    return questions.select("id", F.filter(lines, lambda x: x.isNotNull()).alias("lines"))


def inspect(spark, args) -> int:
    questions = load(spark, args.data, args.subtask)
    if args.json:
        print(json.dumps([json.loads(r[0]) for r in questions.select(F.to_json(F.struct("*"))).limit(args.limit).collect()], ensure_ascii=False, indent=2))
    else:
        print("\n".join(listing(questions, args.limit)))
    return 0


def evaluate(spark, args) -> int:
    gold = load(spark, args.data, args.subtask).select("id", "subtask", F.col("qa.answer").alias("gold"))
    if gold.isEmpty():
        print("No questions found.", file=sys.stderr)
        return 1
    verdicts = E.evaluate(gold, predictions=io.load_predictions(spark, args.predictions), mode=args.mode)
    print(E.summary(E.accuracy(verdicts)))
    if args.output:
        io.write_results(verdicts, args.output)
    return 0


def outside(name: str):
    """A function named ``module:function``; it travels to the executors by value, which need not have its module."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function)
    by_value(module)
    return found


def collect(spark, args) -> int:
    client = outside(args.client)
    companies = io.json_rows(spark, args.companies).select(F.from_json("value", "edinet_code string, name string, industry string, gaap string").alias("c")).select("c.*")
    print(json.dumps(C.collect(companies, args.years, client, f"{args.data_dir}/collected", parallel=args.parallel, pause=args.pause)))
    return 0


def build(spark, args) -> int:
    B.build(spark, args.data_dir, B.STAGES if args.stage == "all" else (args.stage,))
    return 0


def raw_rows(spark, path: str):
    """``idx, value``: a question file's objects as text, numbered in their order."""
    return B.numbered(io.json_rows(spark, path), ("file", "pos"), "idx").select("idx", "value")


def spread_of(rows):
    """The distribution of ``idx, value`` rows."""
    v = F.parse_json("value")
    return A.distribution(rows.select("idx", *(F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in ("subtask", "accounting_standard", "filing_year", "edinet_code", "company_name"))))


def audit(spark, args) -> int:
    """Basic and deep findings; the exit code says whether there are any basic ones."""
    rows = raw_rows(spark, args.data)
    spread = spread_of(rows)
    total = 0
    for name, title, found, kinds in (("audit", "Audit report", A.basic(rows), A.BASIC), ("audit_quality", "Deep audit report", A.deep(io.to_questions(io.json_rows(spark, args.data))), A.DEEP)):
        io.write_rows(found, f"{args.output}/{name}_findings")
        told = A.told(spark.read.schema(found.schema).json(io.current(spark, f"{args.output}/{name}_findings")), spread, kinds)
        io.write_json(spark, f"{args.output}/{name}_report.json", told)
        io.write_text(spark, f"{args.output}/{name}_report.md", A.as_markdown(told, title))
        print("\n".join([title, *(f"  {k}: {n}" for k, n in told["counts"].items())]))
        total += sum(told["counts"][k] for k in kinds) if name == "audit" else 0
    return 1 if total else 0


def integrity(spark, args) -> int:
    companies, filings, _ = io.load_filings(spark, args.data)
    wrong = A.integrity(filings, companies)
    n = wrong.count()
    print(f"{companies.count()} files, {n} violations")
    for r in io.first_rows(wrong, ["file", "year", "issue"], 50).collect():
        print(f"  {r['file']} {r['year'] or ''} {r['issue']}")
    return 1 if n else 0


def lite(spark, args) -> int:
    rows = raw_rows(spark, args.data)
    v = F.parse_json("value")
    own = rows.select(F.col("idx").alias("pos"), *(F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in ("subtask", "accounting_standard", "edinet_code")))
    picked = V.lite(own, args.seed)
    chosen = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in picked], "idx bigint")), "idx")
    chosen.orderBy("idx").coalesce(1).select("value").write.mode("overwrite").text(f"{args.output}/questions")
    told = [r.asDict() for r in spread_of(chosen).orderBy("measure", F.desc("value"), "key").collect()]
    io.write_json(spark, f"{args.output}/manifest.json", {"source": args.data, "seed": args.seed, "lite_size": V.LITE_SIZE, "per_company_cap": V.LITE_CAP, "target_stratum": {f"{a}|{b}": n for (a, b), n in V.LITE_TARGETS.items()}, "row_indices": picked, "distribution": told})
    print(f"Selected {len(picked)} rows")
    return 0


def publish(spark, args) -> int:
    for name, n in io.publish(io.flatten(io.load_final(spark, args.data)), args.output).items():
        print(f"{name}: {n} questions")
    return 0


def run(spark, args) -> int:
    call = outside(args.provider)
    # in the order of the files, or of the ids of a published set
    lines = args.data.endswith((".json", ".jsonl")) or json_files(spark, args.data)
    own = B.numbered(io.to_questions(io.json_rows(spark, args.data)), ("file", "pos"), "place") if lines else B.numbered(load(spark, args.data, None), ("id",), "place")
    context = R.context(F.col("pre_text"), F.col("table.headers"), F.col("table.rows"), F.col("post_text"))
    rows = own.where(F.col("place") < args.limit) if args.limit else own
    rows = rows.select("place", "id", "subtask", F.coalesce("accounting_standard", F.lit("")).alias("accounting_standard"), F.col("qa.question").alias("question"), context.alias("context"), F.col("qa.answer").alias("gold"))
    stored = f"{args.out_dir}/{args.model}__{args.regime}"
    told = runs.run_stored(rows, runs.for_regime(args.model, args.regime, call), f"{stored}__attempts", lambda a: runs.scored(a.drop("place"), args.model), parallel=args.parallel, order=("place",))
    if told["stopped"]:
        print(f"Stopped after {runs.MOST_ERRORS} errors in a row; {told['stored']} of {told['to_ask']} attempts stored.", file=sys.stderr)
    got = runs.metrics(io.load_attempts(spark, f"{stored}__attempts"), args.model, args.regime, args.data)
    io.write_json(spark, f"{stored}__metrics.json", got)
    print(json.dumps(got["summary"], ensure_ascii=False))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    return {"evaluate": evaluate, "inspect": inspect, "collect": collect, "build": build, "audit": audit, "integrity": integrity, "lite": lite, "publish": publish, "run": run}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
