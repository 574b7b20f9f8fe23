"""Command line: ``resolve``, ``trace entry`` and ``common-names``, and the options on the cache."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Config
from .constants import STATS_FILE
from .operators import climb, common_names, grouping, index, resolve, trace
from .sources import backbone, entries, files, sinks, store, verifier

log = logging.getLogger("cladeworks")
_SWITCHES = ("all_matches", "capitalize", "fuzzy_uninomial", "fuzzy_relaxed", "species_group")


def _log_options(p: argparse.ArgumentParser, level, file) -> None:
    p.add_argument("--log-level", default=level, choices=("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"))
    p.add_argument("--log-file", default=file)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cladeworks", description="Align organism records to one taxonomic hierarchy.")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--cache-dir", help="folder of stored tables; else $CLADEWORKS_CACHE_DIR")
    p.add_argument("--cache-input", help="input whose stored tables --cache-stats describes")
    p.add_argument("--show-cache-path", action="store_true")
    p.add_argument("--show-config", action="store_true")
    p.add_argument("--cache-stats", action="store_true")
    p.add_argument("--clear-cache", action="store_true")
    _log_options(p, "INFO", None)
    commands = p.add_subparsers(dest="command")
    r = commands.add_parser("resolve", help="resolve the lineages of entries")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-o", "--output-dir", required=True)
    r.add_argument("--output-format", choices=("parquet", "csv"), default=Config.output_format)
    r.add_argument("--force-input", action="store_true", help="accept the input as it is")
    r.add_argument("--full-rerun", action="store_true", help="delete the files and stored tables of the earlier run and start anew")
    r.add_argument("--refresh-cache", action="store_true", help="compute stored tables anew")
    r.add_argument("--cache-stats", dest="input_cache_stats", action="store_true", help="describe the stored tables of this input and end")
    t = commands.add_parser("trace", help="show what happened to a record").add_subparsers(dest="kind", required=True).add_parser("entry")
    t.add_argument("--uuid", required=True)
    t.add_argument("--from-input", required=True)
    t.add_argument("--format", choices=("json", "text"), default="json")
    t.add_argument("--verbose", action="store_true", help="list all members of the record's group too")
    for x in (r, t):
        x.add_argument("--responses", help="Parquet table of (term, source_id, response)")
        x.add_argument("--verifier", help="name-verifier program to call for terms")
        x.add_argument("--batch-size", type=int, default=Config.batch_size)
        x.add_argument("--jobs", type=int, default=Config.jobs)
        for name in _SWITCHES:
            x.add_argument(f"--{name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=getattr(Config, name))
    c = commands.add_parser("common-names", help="add vernacular names to resolved records")
    c.add_argument("--resolved-dir", required=True)
    c.add_argument("--output-dir", required=True)
    c.add_argument("--backbone", required=True, help="folder with Taxon.tsv and VernacularName.tsv, or an archive of them")
    c.add_argument("--least-archive-bytes", type=int, default=backbone.WHOLE_ARCHIVE, help="an archive of fewer bytes is taken for broken and removed")
    c.add_argument("--higher-rank-fallback", action=argparse.BooleanOptionalAction, default=Config.higher_rank_fallback)
    for x in (r, t, c):  # after a command too, without undoing what stands before it
        _log_options(x, argparse.SUPPRESS, argparse.SUPPRESS)
    return p


def _config(args) -> Config:
    return Config().updated(**vars(args))


def _cache(spark, args, inputs) -> store.TableCache:
    config = _config(args)
    return store.TableCache(spark, config.cache_dir, store.namespace("resolve", files.fingerprint(inputs)), config.cache_max_age)


def _program_answers(spark, args, groups, cache, refresh):
    """Answers of a program, asked rung by rung for what groups come to; batches that it does not answer in full end the run and are kept apart."""
    options = _config(args).verifier_options()
    space = f"answers-{trace.digest(json.dumps({'program': args.verifier, **options}, sort_keys=True))[:12]}"
    keep = lambda name, df: cache.table(f"{space}/{name}", lambda: df, True)

    def ask(lookups):
        ledger = keep(f"ledger-{uuid4().hex}", verifier.program_ledger(lookups, args.verifier, args.batch_size, **options))
        verifier.quarantine(ledger, lambda broken: keep("quarantine", broken))
        return verifier.answers_of(ledger)

    return cache.table(f"{space}/known", lambda: climb.answers(groups, ask, keep), refresh)


def _answers(spark, args, groups, cache, refresh=False):
    """Answers of a table are read where it lies, those of a program are stored."""
    if args.responses:
        return spark.read.parquet(args.responses)
    if args.verifier:
        return _program_answers(spark, args, groups, cache, refresh)
    raise SystemExit("give --responses or --verifier")


def _index_folder(cache, args) -> str:
    return f"{cache.folder}/index-{trace.digest(str(args.responses or args.verifier))[:12]}"


def run_resolve(spark: SparkSession, args) -> int:
    inputs = entries.find_inputs(spark, args.input)
    cache = _cache(spark, args, inputs)
    if args.input_cache_stats:
        print(json.dumps(cache.stats(), indent=2))
        return 0
    if args.full_rerun:
        sinks.delete_listed(spark, args.output_dir, "resolve")
        cache.clear()
    elif sinks.unfinished(spark, args.output_dir):
        log.warning("an earlier run into %s was stopped while its files were put in place; the rest follows now", args.output_dir)
        sinks.finish(spark, args.output_dir)
        return 0
    elif sinks.already_run(spark, args.output_dir) or cache.used():
        log.warning("%s or %s holds an earlier run of this input; use --full-rerun to replace it", args.output_dir, cache.folder)
        return 0
    rows = entries.normalized_entries(entries.read_raw(spark, inputs))
    kind = args.output_format
    names = [r["name"] for r in inputs.files.select("name").orderBy("name").toLocalIterator()]
    sinks.write_manifest(spark, args.output_dir, "resolve", args.input, sinks.intended_for_resolve(names, kind, args.force_input), cache.folder)
    name_of = lambda name, outcome: sinks.output_name(name, outcome, kind)
    if args.force_input:
        sinks.write_by_file(resolve.forced_rows(rows).withColumn("outcome", F.lit("forced")), args.output_dir, inputs.files, name_of, rows.count(), kind)
        return 0
    groups = cache.table("groups", lambda: grouping.group_entries(rows), args.refresh_cache)
    answers = _answers(spark, args, groups, cache, args.refresh_cache)
    final = cache.table(f"final-{trace.digest(str(args.responses or args.verifier))[:12]}", lambda: resolve.final_attempts(groups, answers), True)
    expected = groups.agg(F.coalesce(F.sum("group_count"), F.lit(0))).first()[0]
    index.store(_index_folder(cache, args), rows, resolve.with_attempt_keys(resolve.chains(final), answers), expected)
    final = resolve.force_failed(final)
    out = resolve.output_rows(rows, final).withColumn("outcome", F.when(resolve.is_resolved(), "resolved").otherwise("unsolved"))
    sinks.write_by_file(out, args.output_dir, inputs.files, name_of, expected, kind, {STATS_FILE: sinks.statistics_text(resolve.statistics(final))})
    return 0


def run_trace(spark: SparkSession, args) -> int:
    """The chain that the run over this input has stored is shown; without one the groups of the entry are tried anew."""
    inputs = entries.find_inputs(spark, args.from_input)
    cache = _cache(spark, args, inputs)
    rows = entries.normalized_entries(entries.read_raw(spark, inputs)).drop(*entries.PLACE)
    folder = _index_folder(cache, args)
    stored = {x.rpartition("-")[0]: x for x in store.children(spark, folder) if store.exists(spark, f"{folder}/{x}/_SUCCESS")}
    if len(stored) == 2:
        members, chains = (spark.read.parquet(f"{folder}/{stored[x]}") for x in (index.MEMBERS, index.CHAINS))
        tried = index.attempts_of(members, chains, [args.uuid], int(stored[index.MEMBERS].rpartition("-")[2])).drop("uuid")
        steps = lambda groups: tried
    else:
        steps = lambda groups: resolve.chains(resolve.final_attempts(groups, _answers(spark, args, groups, cache)))
    said = trace.trace_entry(rows, steps, args.uuid).collect()
    for r in said:
        print(trace.as_text(r.trace) if args.format == "text" else r.trace)
    if args.verbose:
        for r in trace.group_members(rows, args.uuid).toLocalIterator():
            print(f"member {r.group_key} {r.uuid}")
    return 0 if said else 1


def run_common_names(spark: SparkSession, args) -> int:
    if sinks.unfinished(spark, args.output_dir):
        sinks.finish(spark, args.output_dir)
        return 0
    taxa_path, names_path = f"{args.backbone}/{backbone.TAXA}", f"{args.backbone}/{backbone.NAMES}"
    if args.backbone.endswith(".zip"):
        taxa_path, names_path = backbone.unpack(args.backbone, os.path.splitext(args.backbone)[0], args.least_archive_bytes)
    taxa = backbone.read_taxa(spark, taxa_path)
    names = common_names.prioritize_vernacular(backbone.read_vernacular(spark, names_path))
    found = backbone.annotations(spark, args.resolved_dir)
    datasets = [r["name"] for r in found.files.select("name").orderBy("name").toLocalIterator()]
    sinks.write_manifest(spark, args.output_dir, "common-names", args.resolved_dir, sinks.intended_for_common_names(datasets))
    if not datasets:
        return 0
    rows = backbone.read_annotations(spark, found)
    out = common_names.add_common_names(rows, taxa, names, args.higher_rank_fallback)
    sinks.write_by_file(out.withColumn("outcome", F.lit("named")), args.output_dir, found.files, lambda name, outcome: name, rows.count())
    return 0


def run_alone(spark_of, args) -> int | None:
    """What options without a command ask for; None if they ask for nothing."""
    config = _config(args)
    if args.show_cache_path:
        print(config.cache_dir)
    elif args.show_config:
        print(config.summary())
    elif args.cache_stats:
        spark = spark_of()
        spaces = [_cache(spark, args, entries.find_inputs(spark, args.cache_input))] if args.cache_input else [store.TableCache(spark, config.cache_dir, x) for x in store.children(spark, config.cache_dir)]
        print(json.dumps([x.stats() for x in spaces], indent=2))
    elif args.clear_cache:
        print(f"{store.clear_all(spark_of(), config.cache_dir)} stored tables removed")
    else:
        return None
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    handlers = [logging.StreamHandler(), *([logging.FileHandler(args.log_file)] if args.log_file else [])]
    logging.basicConfig(level=args.log_level, handlers=handlers)
    # The JVM interprets methods of more than 8000 bytes, so Spark should not generate them.
    spark_of = lambda: SparkSession.builder.appName("cladeworks").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()
    if args.command is None:
        done = run_alone(spark_of, args)
        if done is None:
            parser().print_help()
        return 1 if done is None else done
    if args.clear_cache:
        store.clear_all(spark_of(), _config(args).cache_dir)
    return {"resolve": run_resolve, "trace": run_trace, "common-names": run_common_names}[args.command](spark_of(), args)


if __name__ == "__main__":
    sys.exit(main())
