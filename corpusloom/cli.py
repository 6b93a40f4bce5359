"""Command line: clean, filter, evaluate, predict and leaderboard. Exit code 2 for handled errors."""

from __future__ import annotations

import argparse
import sys

from corpusloom import config as configuration
from corpusloom.session import session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom")
    commands = out.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean", help="clean splits of article/summary pairs")
    clean.add_argument("source")
    clean.add_argument("output")
    clean.add_argument("--config")
    clean.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
    domain = commands.add_parser("filter", help="keep the pairs of a domain")
    domain.add_argument("source")
    domain.add_argument("output")
    domain.add_argument("audit")
    domain.add_argument("--lexicon", help="CSV with category and term; a small demo lexicon if left out")
    score = commands.add_parser("evaluate", help="summarize one split of a table and score it")
    score.add_argument("table", help="CSV or Parquet with article and summary")
    score.add_argument("output")
    score.add_argument("--split", choices=("validation", "test"), default="validation")
    score.add_argument("--no-predictions", action="store_true")
    predict = commands.add_parser("predict", help="summarize one text")
    given = predict.add_mutually_exclusive_group()
    given.add_argument("--text")
    given.add_argument("--file")
    predict.add_argument("--prefix", help="in place of data.source_prefix")
    for command in (score, predict):
        command.add_argument("--model", help="in place of model.name")
        command.add_argument("--config")
        command.add_argument("--set", action="append", default=[], metavar="SECTION.KEY=VALUE")
        command.add_argument("--beams", type=int)
        command.add_argument("--max-length", type=int)
    board = commands.add_parser("leaderboard", help="rank run folders by their metrics")
    board.add_argument("folder")
    return out


def _settings(args: argparse.Namespace) -> configuration.Config:
    """Defaults, then the file, then --set, then the options of their own."""
    config = configuration.load(args.config) if args.config else configuration.Config()
    own = {"model.name": args.model, "generation.num_beams": args.beams, "generation.max_length": args.max_length}
    own["data.source_prefix"] = getattr(args, "prefix", None)
    if args.max_length is not None and args.max_length < config.generation.min_length:
        own["generation.min_length"] = args.max_length
    return configuration.override(config, dict(x.split("=", 1) for x in args.set) | {k: v for k, v in own.items() if v is not None})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "predict":
            from corpusloom.operators.inference import model_of, summarize_text
            from corpusloom.sources.files import read_input_text

            config = _settings(args)
            text = read_input_text(args.text, args.file)
            print(summarize_text(text, model_of(config.model.name, config.generation), config.data.source_prefix))
            return 0
        spark = session()
        if args.command == "clean":
            from corpusloom.plans import cleaning

            config = configuration.load(args.config) if args.config else configuration.Config()
            config = configuration.override(config, dict(x.split("=", 1) for x in args.set))
            cleaning.run(spark, args.source, args.output, config.cleaning)
        elif args.command == "filter":
            from corpusloom.operators.lexicon import demo_lexicon
            from corpusloom.plans import filtering

            lexicon = spark.read.option("header", "true").csv(args.lexicon) if args.lexicon else demo_lexicon(spark)
            filtering.run(spark, args.source, args.output, args.audit, lexicon)
        elif args.command == "evaluate":
            from corpusloom.operators.inference import model_of
            from corpusloom.plans import evaluation
            from corpusloom.sources.pairs import read_pairs

            config = _settings(args)
            rows = read_pairs(spark, args.table).selectExpr("_source_row as index", "article", "summary as reference")
            make = model_of(config.model.name, config.generation)
            for name, value in sorted(evaluation.evaluate(rows, make, args.output, args.split, not args.no_predictions).items()):
                print(f"{name}: {value}")
        else:
            from corpusloom.plans import evaluation

            for row in evaluation.summarize_runs(spark, args.folder):
                print(row)
    except (ValueError, FileNotFoundError, FileExistsError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
