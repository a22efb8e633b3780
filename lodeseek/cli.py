"""Command line: index, search, evaluate, make-benchmark, benchmark (latency) and demo."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from lodeseek.config import load_config, parse_override
from lodeseek.operators import evaluation
from lodeseek.plans.experiments import PRESETS, ablation, throughput
from lodeseek.plans.index import index_dataset, index_repository, write_report
from lodeseek.plans.search import Engine
from lodeseek.sources.dataset import benchmark_of, functions_in_folders, read_dataset, write_dataset
from lodeseek.sources.repository import take_snapshot


def show(found: DataFrame) -> None:
    for r in found.collect():
        also = f" also in {', '.join(r.also_in)}" if r.also_in else ""
        print(f"{r.query_id}.{r.rank} {r.file} {r.function} L{r.start_line}-{r.end_line} {r.score:.3f} {r.version} {r.method} {r.why}{also}")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodeseek", description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("repository")
    index.add_argument("--commit")
    index.add_argument("--label")
    index.add_argument("--full", action="store_true")
    index.add_argument("--base")
    search = commands.add_parser("search")
    search.add_argument("repository")
    search.add_argument("query", nargs="+")
    search.add_argument("--version")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--history", action="store_true")
    search.add_argument("--json", action="store_true")
    measure = commands.add_parser("evaluate")
    measure.add_argument("dataset")
    measure.add_argument("--report")
    measure.add_argument("--ablation", action="store_true")
    make = commands.add_parser("make-benchmark")
    make.add_argument("dataset")
    make.add_argument("folders", nargs="+")
    make.add_argument("--functions", type=int, default=20_000)
    make.add_argument("--queries", type=int, default=500)
    speed = commands.add_parser("benchmark")
    speed.add_argument("dataset")
    speed.add_argument("--rounds", type=int, default=3)
    commands.add_parser("demo").add_argument("folder")
    given = parser.parse_args(args)
    config = load_config(given.config, dict(map(parse_override, given.set)))
    spark = SparkSession.builder.appName("lodeseek").getOrCreate()
    if given.command == "index":
        print(json.dumps(index_repository(spark, given.repository, given.commit, given.label, config, given.full, given.base), indent=1))
    elif given.command == "search":
        engine = Engine(spark, given.repository, config)
        found = engine.search(engine.queries(given.query), given.version, given.top_k, history=given.history).orderBy("query_id", "rank")
        if given.json:
            print("\n".join(found.toJSON().collect()))
        else:
            show(found)
    elif given.command == "make-benchmark":
        made = benchmark_of(functions_in_folders(spark, given.folders, given.functions).cache(), given.queries)
        write_dataset(made, given.dataset)
        print(json.dumps({"functions": made.corpus.count(), "queries": made.queries.count()}))
    elif given.command == "benchmark":
        dataset = read_dataset(spark, given.dataset)
        index_dataset(spark, dataset.corpus, dataset.name, config)
        print(json.dumps(throughput(Engine(spark, dataset.name, config), dataset.queries, given.rounds), indent=1))
    elif given.command == "demo":
        name = index_repository(spark, given.folder, config=config)
        engine = Engine(spark, take_snapshot(given.folder).name, config)
        print(json.dumps(name, indent=1))
        show(engine.search(engine.queries(["where is the input checked", "how is an error handled", "what reads a file"]), top_k=3).orderBy("query_id", "rank"))
    else:
        dataset = read_dataset(spark, given.dataset)
        if given.ablation:
            rows = list(ablation(spark, dataset, config["index"]["dir"], PRESETS))
        else:
            index_dataset(spark, dataset.corpus, dataset.name, config)
            rows = [evaluation.evaluate(Engine(spark, dataset.name, config).run(dataset.queries), dataset.qrels).first().asDict()]
        print(json.dumps(rows, indent=1))
        if given.report:
            write_report(given.report, rows)


if __name__ == "__main__":
    main()
