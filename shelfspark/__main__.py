"""python -m shelfspark --index PATH index|status|ask|chat FOLDER ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _shown(row) -> str:
    lines = [row.answer or "", *(f"  [{c.ref}] {c.file}{', ' + c.pages if c.pages else ''}{' — ' + c.section if c.section else ''}" for c in row.citations)]
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, read=sys.stdin.readline) -> int:
    parser = argparse.ArgumentParser(prog="shelfspark")
    parser.add_argument("--index", required=True, help="folder of the index, in any file system")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("index", "index what is new or changed below a folder"), ("status", "what is known of a folder"), ("ask", "ask one question"), ("chat", "ask line by line")):
        command = commands.add_parser(name, help=text)
        command.add_argument("folder")
        if name == "ask":
            command.add_argument("question")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("shelfspark").getOrCreate()
    from shelfspark.operators import library
    from shelfspark.plans.engine import Engine

    engine, folder = Engine(spark, args.index), os.path.abspath(args.folder)
    if args.command == "index":
        try:
            print(json.dumps(engine.sync_folder(folder)))
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if args.command == "status":
        one = spark.createDataFrame([(folder, folder, None)], "path_key string, path string, synced_at timestamp")
        known = engine.store.folders().filter(F.col("path_key") == folder)
        print(json.dumps(library.folder_summary(engine.store.files(), known.unionByName(one)).first().asDict(), default=str))
        return 0

    def answer(question: str) -> str:
        return _shown(engine.answer(spark.createDataFrame([(1, question)], "query_id long, text string"), folder=folder).first())

    if args.command == "ask":
        print(answer(args.question))
        return 0
    while (line := read()) and line.strip() not in ("", "exit", "quit"):
        print(answer(line.strip()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
