"""Command line: crawl, search and a stdio tool server."""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import inspect
import json
import sys

from pyspark.sql import SparkSession

from ..operators.crawl import crawl_and_index, due_sites
from ..operators.embed import EmbeddingError, create_provider
from ..operators.search import search_store
from ..operators.store import ChunkStore
from ..sources import config as configs
from ..sources.fetch import fetched, http_fetcher
from ..sources.models import ensure_model
from .tools import Tools, as_json, as_text

FLAGS = ("config", "store", "collection", "embedding-provider", "embedding-model", "embedding-url", "embedding-key", "embedding-dimensions", "model-path")
TOOLS = ("search_web_pages", "get_page", "list_urls", "crawl_status")


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    for flag in FLAGS:
        shared.add_argument(f"--{flag}")
    top = argparse.ArgumentParser(prog="pagelode", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", parents=[shared])
    crawl.add_argument("--auto-download", action="store_true")
    crawl.add_argument("--due", action="store_true", help="only sites whose frequency_hours have passed")
    find = commands.add_parser("search", parents=[shared])
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=5)
    find.add_argument("--fresh-days", "--stale-days", type=int, dest="fresh_days")
    find.add_argument("--json", action="store_true")
    commands.add_parser("serve", parents=[shared])
    commands.add_parser("index", parents=[shared], help="makes a vector index of the table as it stands")
    return top


def serve(tools: Tools, source=sys.stdin, out=sys.stdout) -> None:
    """JSON-RPC, one message a line: initialize, tools/list, tools/call. Nothing else goes to the output."""
    for line in source:
        if not line.strip():
            continue
        message = json.loads(line)
        method, params = message.get("method"), message.get("params") or {}
        answer: dict = {}
        if method == "initialize":
            answer = {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "pagelode", "version": "0.1.0"}}}
        elif method == "tools/list":
            described = []
            for name in TOOLS:
                own = inspect.signature(getattr(tools, name)).parameters
                kinds = {k: {"type": "string" if "str" in str(p.annotation) else "number" if "float" in str(p.annotation) else "integer"} for k, p in own.items()}
                needed = [k for k, p in own.items() if p.default is inspect.Parameter.empty]
                described.append({"name": name, "inputSchema": {"type": "object", "properties": kinds, "required": needed}})
            answer = {"result": {"tools": described}}
        elif method == "tools/call" and params.get("name") in TOOLS:
            try:
                text = getattr(tools, params["name"])(**(params.get("arguments") or {}))
                answer = {"result": {"content": [{"type": "text", "text": text}]}}
            except Exception as e:  # noqa: BLE001
                answer = {"error": {"code": -32000, "message": str(e)}}
        else:
            answer = {"error": {"code": -32601, "message": f"unknown method {method}"}}
        if "id" in message:
            print(json.dumps({"jsonrpc": "2.0", "id": message["id"]} | answer), file=out, flush=True)


def main(args: list[str] | None = None, spark: SparkSession | None = None, fetch=None) -> int:
    args = sys.argv[1:] if args is None else args
    options = parser().parse_args(args)
    config = configs.load(args=args)
    embedding = config.embedding.resolved()
    try:
        if embedding.provider.lower() == "onnx":
            ensure_model(config.embedding, auto=getattr(options, "auto_download", False))
        provider = create_provider(embedding)
        spark = spark or SparkSession.builder.appName("pagelode").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        store = ChunkStore(spark, f"{config.store.path}/{config.store.collection}", embedding.dimensions)
        now = datetime.datetime.now(datetime.timezone.utc)
        if options.command == "crawl":
            agent, crawl = config.crawl.user_agent, config.crawl
            if options.due:
                crawl = dataclasses.replace(crawl, sites=due_sites(spark, crawl, store, now))
                if not crawl.sites:
                    print("no site is due", file=sys.stderr)
                    return 0
            fetch = fetch or (lambda urls: fetched(urls, lambda: http_fetcher(agent), crawl.max_concurrency, crawl.request_delay_ms))
            r = crawl_and_index(spark, crawl, store, lambda: create_provider(embedding), fetch, now).first()
            print(f"{r['pages_seen']} pages seen, {r['pages_stored']} stored in {r['chunks_stored']} chunks, {r['pages_failed']} failed", file=sys.stderr)
        elif options.command == "index":
            print(f"version {store.build_index()} indexed", file=sys.stderr)
        elif options.command == "search":
            found = search_store(store, provider.embed(options.query), options.limit, options.fresh_days, now)
            print(as_json(found) if options.json else as_text(found) or "No results found.")
        else:
            serve(Tools(store, provider, [s.url for s in config.crawl.sites]))
    except (EmbeddingError, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
