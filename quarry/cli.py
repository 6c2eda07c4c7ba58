"""Command line: convert, query, schema, storage, bench and parity."""

from __future__ import annotations

import argparse
import json
import re
import statistics
import sys
import time

from quarry.session import build_session
from quarry.sources.tables import open_table


def statements(text: str, markdown: bool) -> list[str]:
    """The SQL statements of a file: lines that start with SELECT in Markdown, else parts between semicolons."""
    if markdown:
        return [line.strip().rstrip(";") for line in text.splitlines() if line.upper().startswith("SELECT ")]
    return [s.strip() for s in re.split(r";\s*(?:\n|$)", text) if s.strip()]


def chosen(spec: str | None, count: int) -> list[int]:
    """1-based numbers of a list such as ``1,3-5``; all without one."""
    if not spec:
        return list(range(1, count + 1))
    out: list[int] = []
    for part in spec.split(","):
        low, _, high = part.partition("-")
        out += range(int(low), int(high or low) + 1)
    return [n for n in out if 1 <= n <= count]


def timings(seconds: list[float]) -> dict[str, float]:
    ordered = sorted(seconds)
    at = lambda q: ordered[min(len(ordered) - 1, round(q * (len(ordered) - 1)))]
    return {"mean": round(statistics.fmean(ordered), 4), "p50": round(at(0.5), 4), "p95": round(at(0.95), 4), "min": round(ordered[0], 4), "max": round(ordered[-1], 4)}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("--conf", action="append", default=[], help="key=value for Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("source"), c.add_argument("target")
    c.add_argument("--cluster-by", default=""), c.add_argument("--rows-per-file", type=int, default=0)
    c.add_argument("--show-schema", action="store_true"), c.add_argument("--show-stats", action="store_true")
    q = commands.add_parser("query")
    q.add_argument("source"), q.add_argument("sql", help="a statement, or a plan as JSON")
    q.add_argument("--format", choices=("json", "table"), default="json"), q.add_argument("--strict", action="store_true"), q.add_argument("--stats", action="store_true", help="run it and tell what it read and did")
    b = commands.add_parser("bench")
    b.add_argument("source"), b.add_argument("file"), b.add_argument("--only"), b.add_argument("--runs", type=int, default=5), b.add_argument("--warmup", type=int, default=2)
    p = commands.add_parser("parity")
    p.add_argument("source"), p.add_argument("file"), p.add_argument("--only")
    args = parser.parse_args(arguments)
    spark = build_session(**{k.replace(".", "__"): v for k, _, v in (x.partition("=") for x in args.conf)})
    if args.command == "convert":
        from quarry.sources.convert import column_storage, convert, schema_report, storage_report

        convert(spark, args.source, args.target, cluster_by=[x for x in args.cluster_by.split(",") if x], rows_per_file=args.rows_per_file)
        done = spark.read.parquet(args.target)
        if args.show_schema:
            print("\n".join(schema_report(done)))
        if args.show_stats:
            column_storage(storage_report(done)).show(1000, truncate=False)
        return 0
    table = open_table(spark, args.source)
    if args.command == "query":
        if args.sql.lstrip().startswith("{"):
            from quarry.plans.compiler import main_frame
            from quarry.plans.model import build_plan

            result = main_frame(table, build_plan(args.sql))
        else:
            result = table.sql(args.sql, strict=args.strict)
        if args.stats:
            from quarry.explore.diagnosis import run_statistics

            print(json.dumps(run_statistics(result)))
        elif args.format == "table":
            result.show(1000, truncate=False)
        else:
            for line in result.toJSON().toLocalIterator():
                print(line)
        return 0
    with open(args.file) as f:
        listed = statements(f.read(), args.file.endswith(".md"))
    bad = 0
    for number in chosen(args.only, len(listed)):
        text = listed[number - 1]
        if args.command == "bench":
            seconds = []
            for run in range(args.warmup + args.runs):
                began = time.perf_counter()
                table.sql(text).write.format("noop").mode("overwrite").save()
                if run >= args.warmup:
                    seconds.append(time.perf_counter() - began)
            print(json.dumps({"query": number, **timings(seconds)}))
        else:
            import duckdb

            from quarry.parity import compare

            con = duckdb.connect()
            con.execute(f"CREATE VIEW source AS SELECT * FROM read_parquet('{args.source}')")
            outcome = compare(str(number), table.sql(text), con, re.sub(r"(?i)\bFROM\s+\w+", "FROM source", text, count=1))
            bad += not outcome.same
            print(f"{number}: {'same' if outcome.same else 'different ' + outcome.note[:300]}")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
