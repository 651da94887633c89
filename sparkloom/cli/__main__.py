"""python -m sparkloom.cli [options] [QUERY]"""

from __future__ import annotations

import argparse
import os
import sys

from .. import config, render
from ..plans.tree import DialectError
from ..session import Engine, session


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sparkloom", description="One read-only SQL dialect over many kinds of data, on Spark.")
    p.add_argument("query", nargs="?")
    p.add_argument("-c", "--config", help="YAML of sources and defaults")
    p.add_argument("-f", "--file", help="read the query from a file ('-': standard input)")
    p.add_argument("-o", "--output", choices=render.FORMATS)
    p.add_argument("--repl", action="store_true", help="a prompt")
    p.add_argument("--explain", action="store_true", help="the plan instead of the rows")
    p.add_argument("--quiet", action="store_true", help="no notices")
    p.add_argument("--max-rows", type=int, help="at most so many rows")
    p.add_argument("--strict", action="store_true", help="a failing cast is an error")
    p.add_argument("--serve", action="store_true", help="an HTTP service")
    p.add_argument("--addr", default="127.0.0.1:8080")
    p.add_argument("--mcp", action="store_true", help="a tool server on standard input and output")
    p.add_argument("--master", default="local[*]", help="Spark's master")
    p.add_argument("--max-agg-groups", type=int, help="taken for compatibility: Spark spills groups by itself")
    p.add_argument("--spill", action="store_true", help="taken for compatibility: Spark spills by itself")
    p.add_argument("--spill-dir", help="where Spark spills (spark.local.dir)")
    return p


def run(engine: Engine, text: str, how: str, explain: bool = False, most: int | None = None, quiet: bool = False, out=None) -> None:
    out = out or sys.stdout
    if explain:
        print(engine.explain(text), file=out)
        return
    result = engine.execute(text)
    if result.frame is None:
        if not quiet:
            print(result.notice, file=out)
        return
    df = result.frame.limit(most) if most is not None else result.frame
    for line in render.lines(df, how):
        print(line, file=out)


def main(args: list[str] | None = None, spark=None) -> int:
    a = arguments().parse_args(args)
    conf = {"spark.local.dir": a.spill_dir} if a.spill_dir else {}
    engine = Engine(spark or session(a.master, **{"spark.ui.showConsoleProgress": "false"} | conf), strict=a.strict)
    try:
        path = a.config or next((x for x in ("sparkloom.yaml", "sparkloom.yml") if os.path.exists(x)), None)
        defaults = config.load(engine, path) if path else {}
        if not path:
            engine.reload()
        how = a.output or defaults.get("output", "table")
        if a.serve:
            from .server import serve

            host, _, port = a.addr.rpartition(":")
            serve(engine, host or "127.0.0.1", int(port), a.max_rows)
        elif a.mcp:
            from .tools import serve_stdio

            serve_stdio(engine, sys.stdin, sys.stdout)
        elif a.repl or not (a.query or a.file):
            from .repl import Repl

            Repl(engine, how).loop()
        else:
            text = a.query
            if a.file:
                text = sys.stdin.read() if a.file == "-" else open(a.file).read()
            run(engine, text, how, a.explain, a.max_rows, a.quiet)
    except (DialectError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # Spark's own errors
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
