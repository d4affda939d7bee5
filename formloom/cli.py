"""Command line: extract from sidecar files, or print the result's schema."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="formloom")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("extract", help="extract fields from sidecar files")
    run.add_argument("sidecars", help="a file, folder or glob that Spark can read")
    run.add_argument("--blueprint", required=True)
    run.add_argument("--settings")
    run.add_argument("--output", required=True, help="folder for results, ledger, review queue and layouts")
    run.add_argument("--run-dir", help="folder of a durable run; stages that are there already are not computed again")
    run.add_argument("--corrections", help="JSON lines of job_id, path and value from reviews")
    schema = sub.add_parser("schema", help="print the JSON Schema of a blueprint's results")
    schema.add_argument("--blueprint", required=True)
    schema.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans.engine import Evidence, FormEngine
    from .sources.evidence import read_sidecars, sidecar_evidence
    from .operators.audit import layout_extractions
    from .plans.runs import Run
    from .schemas import CORRECTIONS
    from .sources.sinks import json_schema, write_records, write_results, write_table

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("formloom").getOrCreate()
    engine = FormEngine.from_files(spark, args.blueprint, getattr(args, "settings", None))
    if args.command == "schema":
        from .sources.evidence import empty

        nothing = engine.extract(Evidence(empty(spark, "spans"), empty(spark, "blocks"), empty(spark, "controls")))
        text = json.dumps(json_schema(nothing.envelopes.select("data", "meta").schema), indent=2)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text)
        return 0
    corrections = spark.read.schema(CORRECTIONS).json(args.corrections) if args.corrections else None
    run = Run(spark, args.run_dir) if args.run_dir else None
    found = engine.extract(Evidence(*sidecar_evidence(read_sidecars(spark, args.sidecars))), corrections=corrections, run=run)
    write_results(found.envelopes, f"{args.output}/results")
    write_table(found.ledger, f"{args.output}/evidence")
    write_table(found.review_queue, f"{args.output}/review")
    write_records(layout_extractions(found.layouts, found.decisions, found.envelopes), f"{args.output}/layouts")
    if found.pending is not None:
        write_records(found.pending, f"{args.output}/pending")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
