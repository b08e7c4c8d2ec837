"""python -m chronolith OP SESSION [name=value ...]: one operation, its result as JSON, cut at 20,000 characters.

python -m chronolith ingest SESSION [out=FOLDER] [fps=N]: tables, summary and meta documents from a session's JSON lines.
python -m chronolith ask SESSION question=TEXT: the question answered by the language provider from the compiled context.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from chronolith import api


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("chronolith").config("spark.ui.enabled", "false").getOrCreate()
    named = dict(a.split("=", 1) for a in args[2:])
    if args[0] == "ingest":
        out = named.get("out", f"{args[1].rstrip('/')}.tables")
        made = api.ingest(spark, args[1], out, float(named["fps"]) if "fps" in named else None)
        print(json.dumps({"out": out, "frames": made.n_frames, "fps": made.fps}))
        return 0
    s = api.load(spark, args[1])
    code, body = (200, api.ask(s, named["question"])) if args[0] == "ask" else api.call(s, args[0], named)
    print(json.dumps(body, default=str)[:20_000])
    return int(code != 200)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
