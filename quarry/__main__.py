"""python -m quarry: index, query, stats, tune, eval, extract and sidecar over a folder of files, each of which prints JSON;
and serve, which offers searches to agents."""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import server
from quarry.operators import chunking, evaluation, tuning
from quarry.plans.strategies import search_all
from quarry.project import BUILT_IN, Project, checked, entries_of, manifest_of, save_manifest, shown, sources_of, weights_of
from quarry.sources import labelled, manifest
from quarry.sources.scratch import stored


def session() -> SparkSession:
    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


#: Flags that win over what --auto decides.
FLAGS = {"tokenizer": str, "bm25_k1": float, "bm25_b": float, "lucene_k1": float, "lucene_b": float, "prose_chars": int, "config_chars": int, "code_chars": int, "default_chars": int, "ast_max_chars": int}


def do_index(p: Project, args: argparse.Namespace) -> dict:
    out = {}
    for name in BUILT_IN if args.strategy == "all" else (args.strategy,):
        found, fresh = p.index(name, args.auto, args.force)
        out[name] = {"fresh": fresh, "chunks": found.lexical.n_docs, "files": found.docs.select("source_path").distinct().count(), "record": p.store.record(name)}
    return out


def do_query(p: Project, args: argparse.Namespace) -> dict:
    checked(args.text, args.top_k)
    asked = p.spark.createDataFrame([(1, args.text)], "query_id int, query string")
    weights = weights_of(args.weights)
    began = time.perf_counter()
    found = stored(p.search(asked, args.top_k, args.auto, args.strategy, weights, args.force), "found")
    took = time.perf_counter() - began
    return {"query": args.text, "strategy": args.strategy, "top_k": args.top_k, "seconds": round(took, 3), "hits": shown(p, found, 0 if args.strategy == "all" else 1, args.lines)}


def do_stats(p: Project, args: argparse.Namespace) -> dict:
    sized = p.texts().withColumn("size", F.octet_length("text"))
    exts = {r.ext: r.n for r in tuning.extension_histogram(sized).collect()}
    return {**tuning.file_signals(sized).first().asDict(), **tuning.chunk_signals(p.chunked(chunking.ChunkingPolicy())).first().asDict(), "ext_histogram": exts}


def do_tune(p: Project, args: argparse.Namespace) -> dict:
    return p.parameters()


def do_eval(p: Project, args: argparse.Namespace) -> dict:
    """Means of each strategy and of their consolidation, metrics of each query, precision by confidence, seconds."""
    queries, golds = labelled.load(p.spark, args.labels)
    names = BUILT_IN if args.strategy == "all" else (args.strategy,)
    found, hits = {n: p.index(n, args.auto, args.force)[0] for n in names}, None
    columns = ("query_id", "arm", "rank", "source_path", "start_line", "end_line")
    times = {}
    runs = {n: (lambda n=n: found[n].search(queries, args.top_k)) for n in names}
    if args.strategy == "all":
        runs["consolidated"] = lambda: search_all(found, queries, args.top_k, weights_of(args.weights)).withColumn("rank", F.col("rank") - 1)
    merged = None
    for name, run in runs.items():
        times[name] = []
        for _ in range(args.repeats):
            began = time.perf_counter()
            rows = stored(run(), "hits")
            times[name].append(time.perf_counter() - began)
        merged = rows if name == "consolidated" else merged
        one = rows.withColumn("arm", F.lit(name)).select(*columns)
        hits = one if hits is None else hits.unionByName(one)
    metrics = stored(evaluation.evaluate(hits, golds, args.top_k), "metrics")
    # the batch is searched at once: a query's seconds are its share
    n = max(1, queries.count())
    out = {r.arm: {"recall": r.recall, "ndcg": r.ndcg, "seconds_cold": round(times[r.arm][0] / n, 4), "seconds_median": round(statistics.median(times[r.arm]) / n, 4)} for r in evaluation.means(metrics).collect()}
    by_query = metrics.join(queries.select("query_id", "category"), "query_id").orderBy("query_id", "arm")
    out["by_query"] = [r.asDict() for r in by_query.collect()]
    if merged is not None:
        relevant = merged.alias("h").join(golds.alias("g"), (F.col("h.query_id") == F.col("g.query_id")) & evaluation.matches(), "left").groupBy("h.query_id", "h.rank", "h.confidence").agg(F.max(F.col("g.gold_idx").isNotNull()).alias("is_relevant"))
        out["by_confidence"] = [r.asDict() for r in evaluation.confidence_validity(relevant).collect()]
    return out


def do_extract(p: Project, args: argparse.Namespace) -> dict:
    p.extract(args.force)
    return {"states": {r.rel: r.state for r in manifest.states(sources_of(p), manifest_of(p)).orderBy("rel").collect()}}


def do_sidecar(p: Project, args: argparse.Namespace) -> dict:
    text = sys.stdin.read() if args.transcript == "-" else open(args.transcript, encoding="utf-8").read()
    own = sources_of(p).where(F.col("rel") == args.file).select("rel", "sha256", F.col("size").alias("source_bytes"), F.lit(text).alias("transcript"))
    made = manifest.registered(own).withColumn("text", manifest.truncated_at_unit(F.lit(text))).withColumn("sidecar", F.concat("rel", F.lit(".md"))).withColumn("sidecar_bytes", F.octet_length("sidecar_text"))
    if made.count() != 1:
        raise ValueError(f"{args.file} is no file to extract from, or its transcript is blank")
    save_manifest(p, entries_of(p, manifest_of(p).where(F.col("rel") != args.file)).unionByName(entries_of(p, made)))
    return {"registered": args.file}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quarry", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    serving = sub.add_parser("serve", help="answer tool calls on standard input and output")
    serving.add_argument("root", nargs="?", default=os.environ.get("QUARRY_ROOT") or os.getcwd(), help="QUARRY_ROOT, or this folder, if it isn't given")
    serving.add_argument("--store", default="./quarry-index")
    for name, does in (("index", do_index), ("query", do_query), ("stats", do_stats), ("tune", do_tune), ("eval", do_eval), ("extract", do_extract), ("sidecar", do_sidecar)):
        one = sub.add_parser(name)
        one.set_defaults(does=does)
        one.add_argument("root")
        if name == "query":
            one.add_argument("text")
            one.add_argument("--lines", type=int, default=60)
        if name == "eval":
            one.add_argument("labels")
        if name == "sidecar":
            one.add_argument("file")
            one.add_argument("transcript", help="a path, or - for standard input")
        if name in ("index", "query", "eval"):
            one.add_argument("--strategy", choices=("all", *BUILT_IN), default="all", help="all: those that need nothing from outside, merged")
        if name in ("query", "eval"):
            one.add_argument("--weights", help="name=number,... of strategies, for merging them")
        if name == "eval":
            one.add_argument("--repeats", type=int, default=3, help="how often each strategy is timed")
        one.add_argument("--no-pdf", action="store_true", help="leave PDF files out")
        for flag, kind in FLAGS.items():
            one.add_argument("--" + flag.replace("_", "-"), type=kind, choices=("plain", "code", "cjk") if flag == "tokenizer" else None)
        one.add_argument("--store", default="./quarry-index")
        one.add_argument("--auto", action="store_true", help="decide parameters from the files")
        one.add_argument("--force", action="store_true")
        one.add_argument("--top-k", type=int, default=5)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "serve":
        return server.run(lambda: Project(session(), args.root, args.store))
    try:
        print(json.dumps(args.does(Project(session(), args.root, args.store, {k: getattr(args, k) for k in FLAGS}, args.no_pdf), args), default=str, ensure_ascii=False))
    except Exception as e:  # the command line's boundary: any failure is said and ends with 1
        print(f"{args.command}: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
