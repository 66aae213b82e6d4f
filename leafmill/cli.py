"""The commands on the command line: ``python -m leafmill <command> ..``; thin, everything is done by the operators."""

from __future__ import annotations

import argparse
import gzip
import os
import shutil
import sys
import tempfile
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import shell
from leafmill.errors import InvalidRecordError, ParseError
from leafmill.functions.text import FORMS
from leafmill.operators import aggregates, check, records as ops, skos
from leafmill.operators.project import Query
from leafmill.sources import scan, sinks

ALIASES = {"cat": "concat", "cnt": "count", "freq": "frequency"}


def session() -> SparkSession:
    spark = SparkSession.builder.appName("leafmill").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser("leafmill")
    commands = main.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, paths: bool = True, filters: bool = True) -> argparse.ArgumentParser:
        own = commands.add_parser(name, aliases=[a for a, n in ALIASES.items() if n == name])
        own.set_defaults(command=name)
        for p in positional:
            own.add_argument(p)
        if paths:
            own.add_argument("path", nargs="*", default=["-"])
        own.add_argument("-p", "--progress", action="store_true")
        own.add_argument("--compression", type=int, choices=range(10))
        if name != "invalid":
            own.add_argument("-s", "--skip-invalid", action="store_true")
            own.add_argument("-l", "--limit", type=int, default=0)
            own.add_argument("--strsim-threshold", type=float, default=80)
            own.add_argument("--filter-normalization", choices=FORMS, default=os.environ.get("LEAFMILL_FILTER_NORMALIZATION"))
        if filters:
            own.add_argument("--where")
        if name not in ("partition", "split"):
            own.add_argument("-o", "--output")
        return own

    command("check").add_argument("-R", "--rule-set", action="append", default=[])
    own = command("concat")
    own.add_argument("-a", "--append", action="store_true")
    own.add_argument("--tee")
    command("count")
    command("dedup")
    command("describe").add_argument("--tsv", action="store_true")
    command("filter", "matcher", filters=False).add_argument("-v", "--invert-match", action="store_true")
    own = command("frequency", "query")
    own.add_argument("-u", "--unique", action="store_true")
    own.add_argument("-r", "--reverse", action="store_true")
    own.add_argument("-t", "--threshold", type=int, default=0)
    own.add_argument("-n", "--num", type=int, default=0)
    own.add_argument("--tsv", action="store_true")
    own.add_argument("-H", "--header")
    command("glimpse", "query").add_argument("-n", "--max-values", type=int, choices=range(1, 256), default=10, metavar="1..255")
    own = command("grep", "pattern")
    own.add_argument("--or", dest="or_", action="append", default=[])
    own.add_argument("-i", "--ignore-case", action="store_true")
    own.add_argument("-v", "--invert-match", action="store_true")
    command("hash").add_argument("--tsv", action="store_true")
    command("invalid", filters=False)
    own = command("partition", "query")
    own.add_argument("-t", "--template", default="{}.mrc")
    own.add_argument("-o", "--output", default=".")
    command("print").add_argument("--translit", choices=FORMS)
    command("sample", "n").add_argument("--seed", type=int)
    own = command("select", "query")
    own.add_argument("--tsv", action="store_true")
    own.add_argument("-H", "--header")
    own = command("skosify")
    own.add_argument("-c", "--config", required=True)
    own.add_argument("--format", choices=("turtle", "nt"))
    own = command("split", "size")
    own.add_argument("--filename", default="{}.mrc")
    own.add_argument("-o", "--outdir", default=".")
    own = commands.add_parser("build-completion")
    own.add_argument("shell", choices=shell.SHELLS)
    own.add_argument("-o", "--output", required=True)
    commands.add_parser("build-man").add_argument("-o", "--outdir", required=True)
    return main


def read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The records that a command works on: readable, matching, limited."""
    mode = "PERMISSIVE" if args.command == "invalid" else "DROPMALFORMED" if args.skip_invalid else "FAILFAST"
    early = "PERMISSIVE" if args.progress else mode  # records are counted before unreadable ones go
    if args.path == ["-"]:
        records = ops.valid(scan.from_bytes(spark, sys.stdin.buffer.read()), early)
    else:
        missing = [p for p in args.path if "://" not in p and not os.path.exists(os.path.expanduser(p)) and not any(c in p for c in "*?[")]
        if missing:
            raise FileNotFoundError(missing[0])
        records = scan.read_files(spark, args.path, early)
    if args.progress:
        # a pass of its own: results are streamed to the terminal, which Spark's observed metrics do not see
        args.seen = records.agg(F.count("*").alias("records"), F.count_if(~F.coalesce("valid", F.lit(True))).alias("invalid"))
        records = ops.valid(records, mode)
    if args.command in ("invalid", "filter"):
        return records
    return ops.where(records, args.where, args.limit, args.strsim_threshold / 100, args.filter_normalization)


def _raw(records: DataFrame, args: argparse.Namespace, append: bool = False, output: str | None = None) -> None:
    output = output or args.output
    rows = records.orderBy("ord") if "ord" in records.columns else records
    if output:
        sinks.single(output, lambda path, zipped: sinks.write_raw(rows.coalesce(1), path, zipped, level=args.compression), append)
        return
    for row in rows.select("raw").toLocalIterator():
        sys.stdout.buffer.write(row["raw"])


def _lines(lines: DataFrame, args: argparse.Namespace, separator: str = "\n") -> None:
    if args.output:
        sinks.single(args.output, lambda path, zipped: sinks.write_text(lines.coalesce(1), path, zipped, separator=separator, level=args.compression))
        return
    for row in lines.toLocalIterator():
        sys.stdout.write(row[0] + separator)


def _table(rows: DataFrame, args: argparse.Namespace, header: bool) -> None:
    import csv

    tsv = getattr(args, "tsv", False) or sinks.is_tsv(args.output)
    if args.output:
        sinks.single(args.output, lambda path, zipped: sinks.write_table(rows.coalesce(1), path, header, tsv, zipped, level=args.compression))
        return
    out = csv.writer(sys.stdout, delimiter="\t" if tsv else ",", lineterminator="\n")
    if header:
        out.writerow(rows.columns)
    for row in rows.toLocalIterator():
        out.writerow(["" if v is None else v for v in row])


def _files(records: DataFrame, by: str, template: str, directory: str, always: Sequence[str] = ()) -> None:
    """A file for each value of a column, named by the template."""
    os.makedirs(directory, exist_ok=True)
    holder = tempfile.mkdtemp(dir=directory)
    try:
        sinks.write_raw(records.withColumn("_name", F.hex(F.encode(F.col(by).cast("string"), "UTF-8"))).sortWithinPartitions("ord"), f"{holder}/out", by="_name")
        found = {}
        for name in sorted(os.listdir(f"{holder}/out")):
            if name.startswith("_name="):
                found[bytes.fromhex(name.removeprefix("_name=")).decode()] = [f"{holder}/out/{name}/{p}" for p in sorted(os.listdir(f"{holder}/out/{name}")) if p.startswith("part-")]
        for value in {*found, *always}:
            with open(os.path.join(directory, template.replace("{}", value)), "wb") as out:
                for part in found.get(value, []):
                    with open(part, "rb") as f:
                        shutil.copyfileobj(f, out)
    finally:
        shutil.rmtree(holder)


def built(args: argparse.Namespace) -> bool:
    """Whether the command was one of those that need no records."""
    if args.command == "build-completion":
        os.makedirs(os.path.dirname(os.path.abspath(args.output)), exist_ok=True)
        with gzip.open(args.output, "wt") if args.output.endswith(".gz") else open(args.output, "w", encoding="utf-8") as out:
            out.write(shell.completion(parser(), args.shell))
    elif args.command == "build-man":
        shell.write_manuals(parser(), args.outdir)
    return args.command.startswith("build-")


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    records = read(spark, args)
    strsim = getattr(args, "strsim_threshold", 80) / 100
    match args.command:
        case "check":
            texts = [open(p, encoding="utf-8").read() for p in args.rule_set]
            found = check.check(records, texts)
            if not any(s.rules for s in map(check.RuleSet.parse, texts)):
                return
            if not args.output or args.output.removesuffix(".gz").endswith(".csv"):
                _table(found, args, header=True)
            elif args.output.removesuffix(".gz").endswith(".txt"):
                _lines(check.report_text(found), args)
            else:
                sinks.write_document(check.report_json(found), args.output, args.compression)
        case "concat":
            if args.tee:
                records = records.cache()
                _raw(records, args, output=args.tee)
            _raw(records, args, args.append)
        case "count":
            _lines(aggregates.count(records).select(F.col("count").cast("string")), args)
        case "dedup":
            _raw(ops.dedup(records), args)
        case "describe":
            found = aggregates.describe(records)
            if not found.isEmpty():
                _table(found, args, header=True)
        case "filter":
            _raw(ops.filter_records(records, args.matcher, args.invert_match, args.limit, strsim, args.filter_normalization), args)
        case "frequency":
            width = Query.parse(args.query).width
            names = [n.strip() for n in args.header.split(",")] if args.header else None
            found = aggregates.frequency(records, args.query, args.unique, args.reverse, args.threshold, args.num, names and names[:width], strsim)
            if names and len(names) > width:  # the last name is the count's
                found = found.withColumnRenamed("count", names[width])
            _table(found, args, header=bool(names))
        case "glimpse":
            _lines(aggregates.glimpse_lines(aggregates.glimpse(records, args.query, args.max_values)), args)
        case "grep":
            _raw(ops.grep(records, args.pattern, args.or_, args.ignore_case, args.invert_match), args)
        case "hash":
            _table(ops.hash_records(records), args, header=True)
        case "invalid":
            _raw(ops.invalid(records), args)
        case "partition":
            _files(ops.partition(records, args.query), "value", args.template, args.output)
        case "print":
            _lines(ops.print_records(records, args.translit).orderBy("ord").select("text"), args, "\n\n")
        case "sample":
            _raw(ops.sample(records, int(args.n), args.seed), args)
        case "select":
            _table(Query.parse(args.query).select(records, args.header, strsim), args, header=bool(args.header))
        case "skosify":
            with open(args.config, encoding="utf-8") as f:
                graph = skos.Graph.parse(f.read())
            form = args.format or ("nt" if (args.output or "").removesuffix(".gz").endswith(".nt") else "turtle")
            triples = skos.skosify(records, graph)
            _lines(skos.ntriples(triples) if form == "nt" else skos.turtle(triples), args)
        case "split":
            _files(ops.split(records, int(args.size)), "chunk", args.filename, args.outdir, always=["0"])


def resolved(argv: Sequence[str]) -> list[str]:
    """Arguments with an abbreviated command written out."""
    known = ["build-completion", "build-man", "check", "concat", "count", "dedup", "describe", "filter", "frequency", "glimpse", "grep", "hash", "invalid", "partition", "print", "sample", "select", "skosify", "split"]
    argv = list(argv)
    if argv and argv[0] not in known and argv[0] not in ALIASES:
        found = [k for k in known if k.startswith(argv[0])]
        if len(found) == 1:
            argv[0] = found[0]
    return argv


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args, more = parser().parse_known_args(resolved(sys.argv[1:] if argv is None else argv))
    if any(a.startswith("-") and a != "-" for a in more):
        parser().error(f"unrecognized arguments: {' '.join(more)}")
    if more:  # paths that follow options
        args.path = [*([] if args.path == ["-"] else args.path), *more]
    try:
        if built(args):
            return 0
        began = time.monotonic()
        run(args, spark or session())
        if args.progress:
            seen, seconds = args.seen.first(), time.monotonic() - began
            print(f"records: {seen['records']}, invalid: {seen['invalid']}, {seen['records'] / max(seconds, 1e-9):.0f} records/s, {seconds:.0f} s", file=sys.stderr)
    except BrokenPipeError:
        return 0
    except (ParseError, InvalidRecordError, FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except Exception as error:  # Spark's own errors: the first line says what is wrong
        print(f"error: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0
