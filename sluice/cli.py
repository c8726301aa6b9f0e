"""Command line: profile, correct, infer and learn."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sluice.operators import events, profile
from sluice.plans import infer, pipeline, report
from sluice.plans.learning import LearningStore
from sluice.plans.policy import Policy, PolicyError, against_columns, load_policy, make_policy, save_policy, unknown_columns
from sluice.sources import tables

#: Rows that inference looks at.
INFER_ROWS = 100_000


def _checked(policy: Policy, columns: list[str], quiet: bool) -> None:
    errors, warnings = against_columns(policy, columns)
    if errors:
        raise PolicyError("; ".join(errors))
    if not quiet:
        for warning in dict.fromkeys([*warnings, *unknown_columns(policy, columns)]):
            print(f"warning: {warning}", file=sys.stderr)


def _profile(spark: SparkSession, args: argparse.Namespace) -> None:
    df, policy = tables.read_table(spark, args.input, multiline=args.multiline), load_policy(args.policy)
    _checked(policy, df.columns, args.quiet)
    found = pipeline.compare(df, policy, args.clock) if args.compare else profile.profile(df, policy, args.clock)
    tables.write_json(found, args.out)


def _inferred(spark: SparkSession, path: str, name: str, store: LearningStore, multiline: bool) -> dict:
    return infer.infer_policy(tables.read_table(spark, path, multiline=multiline).where(f"_row_id <= {INFER_ROWS}"), name, store)


def _infer(spark: SparkSession, args: argparse.Namespace) -> None:
    save_policy(_inferred(spark, args.input, args.name or Path(args.input).stem, LearningStore(args.store), args.multiline), args.out)


def _correct(spark: SparkSession, args: argparse.Namespace) -> None:
    store = LearningStore(args.store)
    given = load_policy(args.policy) if args.policy else make_policy(_inferred(spark, args.input, Path(args.input).stem, store, args.multiline))
    df = tables.read_table(spark, args.input, multiline=args.multiline)
    _checked(given, df.columns, args.quiet)
    if given.output.save_intermediate:
        tables.write_parquet(pipeline.cleaned(df, given)[0].drop("_events"), f"{args.out}.cleaned")
    result = pipeline.correct(df, given, args.clock, extensions=args.extensions).written()
    tables.write_output(result.table(), args.out, "csv" if args.out.endswith(".csv") else given.output.format)
    context = {"input": args.input, "dataset": given.dataset.name, "policy_hash": given.reproducibility.policy_hash}
    found = result.events()
    if given.output.include_audit_log:
        events.write_audit(found, args.audit, args.audit_detail or given.output.audit_detail, context, result.clock)
    if args.policy:
        store.learn(given, infer.BUILTIN)
    if args.report or args.report_md:
        after = profile.profile(result.table(keep_row_id=True), given, result.clock)
        made = report.build_report(profile.profile(df, given, result.clock), after, found, given, result.steps)
        if args.report:
            tables.write_json(made if given.output.include_before_after_scores else {k: v for k, v in made.items() if k != "readiness"}, args.report)
        if args.report_md:
            Path(args.report_md).write_text(report.markdown(made), encoding="utf-8")


def _learn(_: SparkSession | None, args: argparse.Namespace) -> None:
    store = LearningStore(args.store)
    if args.reset:
        store.reset()
    if not args.quiet:
        for name, count in store.summary().items():
            print(f"{name}: {count}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sluice", description="Profiles and cleans tables by a policy, on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--quiet", action="store_true")
    common.add_argument("--store", help="file of learned patterns")
    one = sub.add_parser("profile", parents=[common])
    two = sub.add_parser("correct", parents=[common])
    three = sub.add_parser("infer", parents=[common])
    four = sub.add_parser("learn", parents=[common])
    for p in (one, two, three):
        p.add_argument("--input", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--multiline", action="store_true", help="quoted CSV fields may hold line ends; each file is then read by one task")
    one.add_argument("--policy", required=True)
    one.add_argument("--compare", action="store_true")
    which = two.add_mutually_exclusive_group(required=True)
    which.add_argument("--policy")
    which.add_argument("--auto-policy", action="store_true")
    two.add_argument("--audit", required=True)
    two.add_argument("--audit-detail", choices=("summary", "detailed"))
    two.add_argument("--report")
    two.add_argument("--report-md")
    two.add_argument("--chunksize", type=int, help="accepted and ignored: Spark partitions the input")
    two.add_argument("--extensions", action="store_true", help="also act on duplicates, outliers and missing shares")
    for p in (one, two):
        p.add_argument("--clock", help="a fixed time for reproducible output")
    three.add_argument("--name")
    four.add_argument("--reset", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    run = {"profile": _profile, "correct": _correct, "infer": _infer, "learn": _learn}[args.command]
    if spark is None and args.command != "learn":
        from sluice.session import SETTINGS

        builder = SparkSession.builder.appName("sluice")
        for key, value in SETTINGS.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    try:
        run(spark, args)
    except (PolicyError, ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
