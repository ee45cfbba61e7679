"""The front doors: ``python -m quarry serve`` answers one JSON call per line, ``python -m quarry TOOL '{...}'`` a single one.

``--engine stub`` (the default) or ``--engine hotset --index PATH``. A call is {"tool": name, "arguments": {...}}.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quarry.plans.engines import open_engine
from quarry.plans.tools import PARAMETERS, Tools, schemas


def answer(tools: Tools, line: str) -> str:
    """The envelope of one call, as JSON; what is no call is answered with an error."""
    try:
        call = json.loads(line)
        name, arguments = call["tool"], call.get("arguments", {})
    except (ValueError, KeyError, TypeError):
        return json.dumps({"error": {"kind": "bad_call", "message": "pass {\"tool\": name, \"arguments\": {...}}", "input": line[:200]}})
    out = {"tools": schemas()} if name == "tools" else tools.call(name, arguments)
    return json.dumps(out, ensure_ascii=False, default=str)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    parser.add_argument("what", choices=["serve", "tools", *PARAMETERS])
    parser.add_argument("arguments", nargs="?", default="{}")
    parser.add_argument("--engine", default="stub", choices=["stub", "hotset"])
    parser.add_argument("--index")
    own = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tools = open_engine(spark, own.engine, index=own.index)
    if own.what == "serve":
        for line in sys.stdin:
            print(answer(tools, line), flush=True)
        return 0
    out = answer(tools, json.dumps({"tool": own.what, "arguments": json.loads(own.arguments)}))
    print(out)
    return int("error" in json.loads(out))


if __name__ == "__main__":
    sys.exit(main())
