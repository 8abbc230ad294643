"""Command line: init, doctor, scan, coverage, compile, update, verify. Exit codes: 0 done, 1 failed or issues found, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from gneiss.operators import coverage
from gneiss.plans import bundle, scan, state, validation
from gneiss.sources.config import Config, load_config

STARTER = 'schema = 1\n\n[scan]\ninclude_hidden = false\n\n[output]\ndirectory = "knowledge"\nlocale = "en"\n\n[verify]\nminimum_coverage = 0.0\n'


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gneiss", description=__doc__)
    out.add_argument("command", choices=["init", "doctor", "scan", "coverage", "compile", "update", "verify"])
    out.add_argument("root", nargs="?", default=".")
    out.add_argument("--config", help="configuration file; gneiss.toml of the tree if it exists")
    out.add_argument("--output", help="folder of the bundle; that of the configuration by default")
    out.add_argument("--state", help="folder of the written relations; beside the bundle by default")
    return out


def settings(root: str, path: str | None) -> Config:
    own = os.path.join(root, "gneiss.toml")
    if path is None and not os.path.exists(own):
        return Config()
    return load_config(path or own)


def show(df) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "init":
        path = args.config or os.path.join(args.root, "gneiss.toml")
        if os.path.exists(path):
            print(f"{path} exists", file=sys.stderr)
            return 1
        with open(path, "w", encoding="utf-8") as f:
            f.write(STARTER)
        return 0
    config = settings(args.root, args.config)
    folder = args.output or os.path.join(args.root, config.output.directory)
    kept = "file://" + os.path.abspath(args.state or f"{folder}.state")
    if args.command == "doctor":
        print(json.dumps({"spark": spark.version, "state": state.read_state(spark, kept) is not None, "bundle": os.path.exists(os.path.join(folder, bundle.MARKER))}))
        return 0
    options = config.scan
    options.excluded_roots = sorted({*options.excluded_roots, *(os.path.relpath(x, args.root) for x in (folder, kept.removeprefix("file://")))})
    ir = scan.scan(spark, args.root, options)
    if args.command == "scan":
        print(state.summary(ir))
        state.write_state(ir, kept, config)
        return 0
    if args.command == "coverage":
        print(json.dumps(show(coverage.coverage_counts(ir.coverage))[0] | {"unresolved_items": show(state.unresolved(ir))}, ensure_ascii=False))
        return 0
    if args.command == "verify":
        issues = bundle.verify(ir, bundle.read_bundle(spark, folder), config.output.locale, config.verify.minimum_coverage).withColumnRenamed("document", "subject")
        found = show(validation.report(issues))[0]
        print(json.dumps(found | {"issues": show(validation.in_order(issues))}, ensure_ascii=False))
        return 0 if found["valid"] and not (config.verify.strict and found["warnings"]) else 1
    old = state.read_state(spark, kept)
    if args.command == "update" and old and not state.needs_rebuild(old[1], config) and os.path.isdir(folder):
        print(json.dumps(bundle.update(bundle.state_of(old[0]), ir, folder, config.output.locale)))
    else:
        print(f"wrote {bundle.write_bundle(bundle.render(ir, config.output.locale), folder)} documents")
    state.write_state(ir, kept, config)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as error:
        return 2 if error.code else 0
    spark = spark or SparkSession.builder.appName("gneiss").config("spark.ui.enabled", "false").getOrCreate()
    try:
        return run(spark, args)
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
