"""python -m siftwell crawl | build-index | search | suggest | stats | validate-data."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell.functions import urls
from siftwell.operators import frontier, index, quality, suggest
from siftwell.plans import crawl as crawling
from siftwell.plans.search import TYPES, SearchEngine
from siftwell.sources import fetch, tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="siftwell")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-index")
    build.add_argument("--corpus", required=True, help="JSON lines")
    build.add_argument("--stop-words")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--type", choices=TYPES, default="normal")
    find.add_argument("--user", default="default")
    find.add_argument("--page", type=int, default=1)
    find.add_argument("--page-size", type=int, default=10)
    find.add_argument("--match-mode", choices=("or", "and"), default="or")
    find.add_argument("--rank-by", choices=("score", "final_score", "date"), default="score")
    for name in ("source", "file-type", "date-from", "date-to"):
        find.add_argument(f"--{name}", default="")
    walk = commands.add_parser("crawl")
    walk.add_argument("--seeds", required=True, help="the nested seed file")
    walk.add_argument("--path", required=True, help="folder of the crawl's tables")
    walk.add_argument("--limit", type=int, default=1000, help="documents that are wanted")
    walk.add_argument("--batch-size", type=int, default=100)
    walk.add_argument("--delay", type=float, default=1.0, help="seconds between a task's requests")
    walk.add_argument("--resume", action="store_true", help="go on from the state under the path")
    walk.add_argument("--no-balance", action="store_true", help="by priority alone, not source by source")
    walk.add_argument("--max-source-ratio", type=float, default=0.3)
    hints = commands.add_parser("suggest")
    hints.add_argument("prefix")
    hints.add_argument("--logs", required=True)
    for c in (build, find, hints):
        c.add_argument("--index", required=True)
    for name in ("stats", "validate-data"):
        c = commands.add_parser(name)
        c.add_argument("--corpus", required=True)
        c.add_argument("--out", help="folder for the full report")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("siftwell").getOrCreate()
    if args.command == "crawl":
        config = tables.read_seeds(spark, args.seeds)
        first = config.first()  # one file
        sites = [(s["base_url"], s["name"]) for s in first["sources"]]
        get = lambda asked: fetch.fetch_pages(asked.repartition(urls.domain(F.col("url"))), delay=args.delay)
        load = lambda asked: fetch.fetch_files(asked.repartition(urls.domain(F.col("url"))), delay=args.delay)
        start = None if args.resume else frontier.seeds(config)
        batches = -(-args.limit // args.batch_size)
        crawling.crawl(spark, args.path, start, get, first["allowed_domains"], args.batch_size, batches, not args.no_balance, load, sites, args.limit, args.max_source_ratio)
        crawling.statistics(spark, args.path).show(vertical=True)
        crawling.sources(spark, args.path, args.limit, args.max_source_ratio).show(100, truncate=False)
    elif args.command == "build-index":
        stop = tables.read_stop_words(spark, args.stop_words) if args.stop_words else ()
        index.build(tables.read_corpus(spark, args.corpus), stop).save(args.index)
        index.Index.load(spark, args.index).statistics().show()
    elif args.command == "search":
        engine = SearchEngine(index.Index.load(spark, args.index))
        filters = {k: getattr(args, k) for k in ("source", "file_type", "date_from", "date_to")}
        found = engine.search(args.query, args.type, args.user, args.page, args.page_size, filters, args.match_mode, args.rank_by)
        print({k: v for k, v in found.items() if k != "results"})
        found["results"].select("doc_id", "score", "final_score", "title_highlight", "snippet", "match_explanation").show(args.page_size, truncate=100)
    elif args.command == "suggest":
        suggest.suggestions(index.Index.load(spark, args.index).docs, spark.read.parquet(args.logs), args.prefix).show(truncate=False)
    else:
        docs = tables.read_corpus(spark, args.corpus)
        if args.command == "stats":
            quality.file_counts(docs).show(vertical=True)
            quality.distributions(docs).orderBy("dimension", "n").show(200, truncate=False)
        else:
            quality.verdicts(quality.validation(docs)).show(vertical=True, truncate=False)
        if args.out:
            tables.write_report(docs, args.out)


if __name__ == "__main__":
    main()
