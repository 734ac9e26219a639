"""Command line: ``query``, ``sql``, ``ingest``, ``shard list``, ``shard inspect``, ``storage check``, ``storage summarize``, ``serve``."""

from __future__ import annotations

import argparse
import signal
import sys
import threading

from sedimenta import config, ops_http, storage
from sedimenta.errors import EngineError
from sedimenta.functions.rewrite import prepare, rewrite
from sedimenta.functions.times import SHARDINGS
from sedimenta.operators import native_query
from sedimenta.session import Engine
from sedimenta.sources import ingest
from sedimenta.sources.dataset import Dataset


def _scale(text: str) -> tuple[str, int]:
    name, eq, n = text.partition("=")
    if not eq or not n.isdigit():
        raise argparse.ArgumentTypeError("a scale is column=digits")
    return name, int(n)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sedimenta")
    verbs = p.add_subparsers(dest="verb", required=True)
    q = verbs.add_parser("query")
    q.add_argument("dataset")
    q.add_argument("--metric", action="append", required=True)
    q.add_argument("--filter", action="append", default=[])
    q.add_argument("--aggregate", choices=native_query.AGGREGATES, default="sum")
    q.add_argument("--from", dest="start")
    q.add_argument("--to", dest="end")
    s = verbs.add_parser("sql")
    s.add_argument("dataset")
    s.add_argument("statement")
    i = verbs.add_parser("ingest")
    i.add_argument("source")
    i.add_argument("dataset")
    i.add_argument("--time", required=True)
    for role in ("metric", "int", "string"):
        i.add_argument(f"--{role}", action="append", default=[])
    i.add_argument("--scale", action="append", type=_scale, default=[])
    i.add_argument("--shard-by", choices=SHARDINGS, default="daily")
    i.add_argument("--format", choices=("csv", "tsv", "parquet"))
    i.add_argument("--delimiter")
    sh = verbs.add_parser("shard").add_subparsers(dest="what", required=True)
    sh.add_parser("list").add_argument("dataset")
    one = sh.add_parser("inspect")
    one.add_argument("dataset")
    one.add_argument("shard")
    st = verbs.add_parser("storage").add_subparsers(dest="what", required=True)
    for what in ("check", "summarize"):
        st.add_parser(what).add_argument("url")
    v = verbs.add_parser("serve")
    v.add_argument("root")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--config")
    return p


def serve(engine: Engine, host: str, port: int, stop: threading.Event, out=None) -> None:
    """Serve health, counters and status until ``stop`` is set, then drain the engine's sessions."""
    server = ops_http.serve(engine, port, host)
    print(f"serving {engine.root} at http://{host}:{server.server_port}", file=out, flush=True)
    try:
        while not stop.wait(engine.settings.sweep_seconds):
            engine.sweep()
    finally:
        engine.drain()
        server.shutdown()
        server.server_close()


def run(args: argparse.Namespace, spark, out=None) -> None:
    prepare(spark)
    if args.verb == "query":
        print(native_query.render(native_query.run(Dataset.open(spark, args.dataset), args.metric, args.filter, args.aggregate, args.start, args.end)), file=out)
    elif args.verb == "sql":
        Dataset.open(spark, args.dataset).register("t")
        print(spark.sql(rewrite(args.statement))._show_string(1000, False, False), file=out)
    elif args.verb == "ingest":
        roles = ingest.Roles(args.time, tuple(args.metric), tuple(args.int), tuple(args.string), dict(args.scale), args.shard_by)
        schema = ingest.ingest(spark, args.source, args.dataset, roles, args.format, args.delimiter)
        print(f"ingested {', '.join(f.name for f in schema.fields)} into {args.dataset}", file=out)
    elif args.verb == "shard":
        d = Dataset.open(spark, args.dataset)
        found = d.shards().orderBy("shard") if args.what == "list" else d.inspect(args.shard)
        print(found._show_string(1000, False, False), file=out)
    elif args.verb == "serve":
        stop = threading.Event()
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
        serve(Engine(spark, args.root, config.Settings.load(file=args.config)), args.host, args.port, stop, out)
    elif args.what == "check":
        c = storage.check(spark, args.url)
        print("\n".join([*c["first"], f"{c['objects']} objects, {c['bytes']} bytes"]), file=out)
    else:
        print(storage.summarize(spark, args.url).orderBy("prefix")._show_string(1000, False, False), file=out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        run(args, config.session())
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
