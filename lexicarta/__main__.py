"""``spark-submit ... -m lexicarta {extract,features,topics,run,append,merge} ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexicarta.operators.features import TOP
from lexicarta.operators.topics import TOP_DOCUMENTS, TOPICS
from lexicarta.operators.vocabulary import MIN_DOC_FREQUENCY, MIN_SHARE, MIN_TOKEN
from lexicarta.plans import jobs

FEATURE_OPTIONS = {
    "min_share": dict(type=float, default=MIN_SHARE),
    "threshold_by": dict(choices=["occurrences", "documents"], default="occurrences"),
    "clean_docs": dict(action="store_true"),
    "min_token": dict(type=int, default=MIN_TOKEN),
    "min_doc_frequency": dict(type=int, default=MIN_DOC_FREQUENCY),
    "top": dict(type=int, default=TOP),
}
TOPIC_OPTIONS = {
    "k": dict(type=int, default=TOPICS),
    "top": dict(type=int, default=TOP),
    "top_documents": dict(type=int, default=TOP_DOCUMENTS),
    "max_iter": dict(type=int, default=20),
    "seed": dict(type=int, default=17),
    "optimizer": dict(choices=["em", "online"], default="em"),
    "mixtures": dict(choices=["training", "inferred"], default="training"),
}


def _add(command: argparse.ArgumentParser, options: dict) -> None:
    for name, settings in options.items():
        command.add_argument("--" + name.replace("_", "-"), **settings)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexicarta")
    commands = top.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="abstracts out of tagged record files")
    features = commands.add_parser("features", help="dictionary, vectors and document words")
    topics = commands.add_parser("topics", help="topic model and its reports")
    run = commands.add_parser("run", help="all three")

    append = commands.add_parser("append", help="record files as the next batch of a store")
    merge = commands.add_parser("merge", help="vectors and dictionary of all batches of a store")

    append.add_argument("--layout", choices=["article", "patent"], required=True)
    append.add_argument("--source", required=True)
    append.add_argument("--compat", action="store_true")
    merge.add_argument("--out", required=True)
    for command in (append, merge):
        command.add_argument("--store", required=True)
        command.add_argument("--stop-words", dest="stop_words_path")
    _add(append, {name: FEATURE_OPTIONS[name] for name in ("min_token", "clean_docs")})
    _add(merge, {name: FEATURE_OPTIONS[name] for name in ("min_share", "threshold_by", "min_doc_frequency")})
    for command in (extract, run):
        command.add_argument("--layout", choices=["article", "patent"], required=True)
        command.add_argument("--source")
        command.add_argument("--train")
    for command in (extract, features, run):
        command.add_argument("--stop-words", dest="stop_words_path")
    features.add_argument("--documents", required=True)
    features.add_argument("--label-ranges", dest="label_ranges_path")
    topics.add_argument("--vectors", required=True)
    topics.add_argument("--dictionary", dest="dictionary_path", required=True)
    _add(features, FEATURE_OPTIONS)
    _add(topics, TOPIC_OPTIONS)
    _add(run, FEATURE_OPTIONS | TOPIC_OPTIONS)
    for command in (extract, features, topics, run):
        command.add_argument("--out", required=True)
        command.add_argument("--compat", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    arguments = vars(parser().parse_args(argv))
    command = arguments.pop("command")
    if command == "run":
        given = dict(arguments)
        arguments = {k: v for k, v in given.items() if k not in FEATURE_OPTIONS | TOPIC_OPTIONS}
        arguments["feature_options"] = {k: given[k] for k in FEATURE_OPTIONS}
        arguments["topic_options"] = {k: given[k] for k in TOPIC_OPTIONS}
    getattr(jobs, command)(
        SparkSession.builder.appName("lexicarta").getOrCreate(), **arguments
    )


if __name__ == "__main__":
    main()
