"""Command line: convert, validate, introspect, generate-mapping, list-shapes, benchmark, map-wizard, synthesize."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from nestwright.errors import NestwrightError
from nestwright.operators import matcher, synth
from nestwright.operators.shapes import Registry, Shapes, context_names
from nestwright.pipeline import Pipeline
from nestwright.plans.spec import load
from nestwright.sinks import files
from nestwright.sources.files import source_for


def session() -> SparkSession:
    return SparkSession.builder.appName("nestwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _spec(args):
    return load(args.shape) if args.shape.endswith((".yaml", ".yml")) else Registry(*args.shapes_dir).get(args.shape).spec()


def _source(args):
    return source_for(session(), args.input, **({"sheet": args.sheet} if getattr(args, "sheet", None) else {}))


def convert(args) -> int:
    p = Pipeline(_source(args), _spec(args), dead_letters=args.dead_letters, validate_mode="report" if args.validate else None)
    run = {"json": lambda: p.to_json(args.output, args.pretty), "ndjson": lambda: p.to_ndjson(args.output), "parts": lambda: p.to_parts(args.output, args.mode)}[args.format]
    r = run()
    print(f"{r.records_out} documents, {r.records_failed} failed, {r.bytes_written} bytes, {r.elapsed:.1f} s")
    return 0


def validate(args) -> int:
    folder = Registry(*args.shapes_dir).get(args.shape) if args.shacl else None
    shapes, names = (folder.shapes(), context_names(folder.context)) if folder else (None, None)
    p = Pipeline(_source(args), _spec(args), allowed=shapes.allowed_values() if shapes else None)
    table, issues = p.validate(args.mode, args.sample_rate, shacl=shapes, names=names)
    facts = table.head().asDict()
    if args.report_path:
        if args.report_format in ("json", "html"):
            {"json": files.report_json, "html": files.report_html}[args.report_format](facts, issues, args.report_path)
        else:
            {"csv": files.report_csv, "parquet": files.report_parquet}[args.report_format](issues, args.report_path)
    print(json.dumps(facts))
    return 0 if facts["conforms"] else 1


def introspect(args) -> int:
    shapes = Shapes(Path(args.shacl).read_text(encoding="utf-8"))
    if args.format == "json":
        print(json.dumps(shapes.tree(), indent=2, default=list))
        return 0
    for s in shapes.shapes.values():
        print(f"## {s.local}" if args.format == "markdown" else s.local)
        for p in s.properties:
            print(f"- {p.path} {p.datatype or p.node or ''} [{p.min_count or 0}..{'*' if p.max_count is None else p.max_count}]")
    return 0


def generate_mapping(args) -> int:
    import yaml

    names = context_names(json.loads(Path(args.context_file).read_text(encoding="utf-8"))) if args.context_file else {}
    template = Shapes(Path(args.shacl).read_text(encoding="utf-8")).template(args.context_url, args.base_uri, names)
    Path(args.output).write_text(yaml.safe_dump(template, sort_keys=False), encoding="utf-8")
    return 0


def list_shapes(args) -> int:
    print("\n".join(Registry(*args.shapes_dir).available()))
    return 0


def benchmark(args) -> int:
    spec = _spec(args)
    rows = synth.generate(session(), spec, args.records).cache()
    rows.count()
    p = Pipeline(rows, spec)
    for name, frame in (("map and build", p.documents()), ("serialise", p.json())):
        began = time.time()
        frame.write.format("noop").mode("overwrite").save()
        took = time.time() - began
        print(f"{name}: {took:.2f} s, {args.records / took:.0f} records/s")
    return 0


def map_wizard(args) -> int:
    df, registry = _source(args), Registry(*args.shapes_dir)
    names = {}
    if args.shape:
        folder = registry.get(args.shape)
    else:
        folders = {n: registry.get(n) for n in registry.available() if registry.get(n).shacl}
        ranked = matcher.detect(df.columns, {n: matcher.targets(f.shapes(), context_names(f.context)) for n, f in folders.items()})
        if not ranked:
            raise NestwrightError("no shape to match with")
        folder = folders[ranked[0][0]]
    names = context_names(folder.context)
    config, found = matcher.suggest(df, folder.shapes(), names, least=args.threshold)
    text = matcher.annotated_yaml(config, found, df.columns)
    if args.output:
        Path(args.output).write_text(text, encoding="utf-8")
    else:
        print(text)
    return 0


def synthesize(args) -> int:
    rows = synth.generate(session(), _spec(args), args.records, args.seed)
    (rows.write.mode("overwrite").option("header", True).csv if args.output.endswith(".csv") else rows.write.mode("overwrite").json)(args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nestwright")
    commands = top.add_subparsers(required=True)

    def command(f, *options):
        c = commands.add_parser(f.__name__.replace("_", "-"))
        c.set_defaults(run=f)
        c.add_argument("--shapes-dir", action="append", default=[])
        for flags, settings in options:
            c.add_argument(*flags, **settings)

    o = lambda *flags, **settings: (flags, settings)
    shape, source, out = o("-s", "--shape", required=True), o("-i", "--input", required=True), o("-o", "--output", required=True)
    command(convert, shape, source, out, o("-f", "--format", choices=("json", "ndjson", "parts"), default="ndjson"), o("--mode", choices=tuple(files.MODES), default="error"), o("--sheet"), o("--validate", action="store_true"), o("--pretty", action="store_true"), o("--dead-letters"))
    command(validate, shape, source, o("--mode", choices=("report", "strict", "sample"), default="report"), o("--shacl", action="store_true"), o("--sample-rate", type=float, default=0.1), o("--report-format", choices=("json", "html", "csv", "parquet"), default="json"), o("--report-path"), o("--sheet"))
    command(introspect, o("--shacl", required=True), o("--format", choices=("text", "json", "markdown"), default="text"))
    command(generate_mapping, o("--shacl", required=True), out, o("--context-url", default=""), o("--base-uri", default="ex:record/"), o("--context-file"))
    command(list_shapes)
    command(benchmark, shape, o("-n", "--records", type=int, default=100_000))
    command(map_wizard, source, o("-s", "--shape"), o("-o", "--output"), o("--threshold", type=float, default=matcher.LEAST_SCORE), o("--sheet"))
    command(synthesize, shape, out, o("-n", "--records", type=int, default=1000), o("--seed", type=int, default=0))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (NestwrightError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
