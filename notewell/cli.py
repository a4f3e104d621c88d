"""Command line: index, reindex, search, archaeology, stats, snapshots, log, models, vaults, config."""

from __future__ import annotations

import argparse
import dataclasses
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import NoteEngine
from .operators import log_stats, topics
from .operators.filters import QueryFilter, Wanted
from .plans import registry
from .plans.search import SearchParams
from .session import build_session


def _show(rows: DataFrame) -> None:
    for r in rows.toJSON().collect():
        print(r)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="notewell")
    top.add_argument("--vault", help="its folder; with a configuration also its name there")
    top.add_argument("--index", help="by default the configured folder, else one in the vault")
    top.add_argument("--name", help="of the vault in links")
    top.add_argument("--config", help="a JSON file; without --vault also the one that NOTEWELL_CONFIG names")
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("index", "reindex"):
        sub.add_parser(name).add_argument("--force", action="store_true")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--mode", choices=("semantic", "hybrid", "bm25"), default="hybrid")
    find.add_argument("--limit", type=int)
    find.add_argument("--min-score", type=float, default=0.3)
    find.add_argument("--rerank", action=argparse.BooleanOptionalAction, default=True)
    find.add_argument("--expand", action="store_true")
    find.add_argument("--no-time-boost", action="store_true")
    find.add_argument("--no-log", action="store_true")
    for kind in ("type", "tag", "path", "file"):
        find.add_argument(f"--{kind}", action="append", default=[])
        find.add_argument(f"--not-{kind}", action="append", default=[])
    for flag in ("--prop", "--not-prop"):
        find.add_argument(flag, action="append", default=[], metavar="NAME=VALUE")
    kept = sub.add_parser("snapshots")
    kept.add_argument("action", choices=("stats", "backup", "restore", "vacuum", "clear"))
    kept.add_argument("--to", default="backup", help="name of the backup")
    kept.add_argument("--keep", type=int, default=2, help="versions that vacuum leaves")
    topic = sub.add_parser("archaeology")
    topic.add_argument("query")
    topic.add_argument("--threshold", type=float, default=0.2)
    topic.add_argument("--exclude-daily", action="store_true")
    sub.add_parser("stats")
    sub.add_parser("log").add_argument("--recent", type=int, default=0)
    for name in ("models", "vaults", "config"):
        sub.add_parser(name)
    return top


def chosen_vault(args: argparse.Namespace, config: registry.Config | None) -> registry.Vault:
    """By name or folder; a folder that the configuration does not list is a vault all the same."""
    if config is None:
        return registry.Vault("vault", args.vault)
    try:
        return registry.find_vault(registry.known_vaults(config), args.vault)
    except LookupError:
        if not Path(args.vault).expanduser().is_dir():
            raise
        return registry.Vault(Path(args.vault).name, args.vault)


def run(args: argparse.Namespace) -> None:
    if args.command == "models":
        for m in registry.MODELS:
            print(json.dumps(m.__dict__))
        return
    listing = args.command in ("vaults", "config")
    config = registry.load_config(args.config) if args.config or listing or not args.vault else None
    if args.command == "config":
        print(json.dumps(dataclasses.asdict(config)))
        return
    if args.command == "vaults":
        for v in registry.known_vaults(config):
            print(json.dumps({**dataclasses.asdict(v), "index_path": registry.storage_dir(config, v.path)}))
        return
    vault = chosen_vault(args, config)
    index = args.index or registry.storage_dir(config, vault.path)
    engine = NoteEngine(build_session("notewell", args.master), vault.path, index, args.name or vault.name)
    log = f"{index.rstrip('/')}/log"
    if args.command in ("index", "reindex"):
        print(json.dumps(engine.reindex(force=args.force)))
    elif args.command == "search":
        wanted = {k: Wanted(tuple(getattr(args, k)), tuple(getattr(args, f"not_{k}"))) for k in ("type", "tag", "path", "file")}
        pairs = [tuple(tuple(x.partition("=")[::2]) for x in some) for some in (args.prop, args.not_prop)]
        chosen = QueryFilter(properties=Wanted(*pairs), types=wanted["type"], tags=wanted["tag"], paths=wanted["path"], files=wanted["file"])
        params = SearchParams(args.query, args.mode, registry.bounded_limit(config, args.limit), args.min_score, args.rerank, time_boost=not args.no_time_boost, query_filter=chosen)
        answer = engine.answer(params, args.expand)
        for r in answer.rows:
            print(json.dumps(r.asDict(recursive=True), default=str))
        if not args.no_log:
            engine.log(params, answer, log, args.expand)
    elif args.command == "archaeology":
        found, months = engine.topic(args.query, args.threshold, args.exclude_daily)
        _show(topics.strongest(found).select("date", "relative_path", F.round("similarity", 4).alias("similarity")))
        _show(months.orderBy("month"))
        _show(topics.peaks(months).select(F.col("month").alias("peak")))
        _show(topics.dormant(months).orderBy("month").withColumnRenamed("month", "dormant"))
        _show(topics.bars(months).orderBy("month"))
    elif args.command == "snapshots":
        if args.action in ("backup", "restore"):
            getattr(engine.store, args.action)(args.to)
        elif args.action == "vacuum":
            engine.store.vacuum(args.keep)
        elif args.action == "clear":
            engine.store.clear()
        print(json.dumps(engine.store.stats()))
    elif args.command == "stats":
        _show(engine.stats())
    elif args.command == "log":
        rows = engine.spark.read.parquet(log)
        for part in (log_stats.totals(rows), log_stats.by_mode(rows), log_stats.timing(rows)):
            _show(part)
        if args.recent:
            _show(rows.orderBy(F.desc("ts")).limit(args.recent))


def main(argv: list[str] | None = None) -> None:
    run(parser().parse_args(argv))


if __name__ == "__main__":
    main()
