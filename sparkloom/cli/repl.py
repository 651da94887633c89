"""A prompt: statements end with a semicolon or a blank line; commands begin with a dot."""

from __future__ import annotations

import sys

from .. import render
from ..functions import aggregates, scalar, windows
from ..session import Engine

HELP = """.tables            names that can stand in FROM
.sources           the same, with where they come from
.schema NAME       a relation's columns
.functions         all functions
.use NAME REF      register prefix:path under a name
.output FORMAT     table, csv, json, ndjson, yaml or raw
.explain on|off    show plans instead of rows
.strict on|off     whether a failing cast is an error
.help              this
.quit              leave"""


class Repl:
    def __init__(self, engine: Engine, how: str = "table", source=None, out=None):
        self.engine, self.how, self.source, self.out, self.explain = engine, how, source or sys.stdin, out or sys.stdout, False

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def loop(self) -> None:
        held: list[str] = []
        for line in self.source:
            line = line.rstrip("\n")
            if not held and line.strip().startswith("."):
                if self.command(line.strip()):
                    return
                continue
            if line.strip():
                held.append(line)
            if held and (line.rstrip().endswith(";") or not line.strip()):
                self.statement("\n".join(held))
                held = []
        if held:
            self.statement("\n".join(held))

    def statement(self, text: str) -> None:
        from .__main__ import run

        try:
            run(self.engine, text, self.how, self.explain, out=self.out)
        except Exception as e:
            self.say(f"error: {str(e).splitlines()[0]}")

    def command(self, line: str) -> bool:
        """Whether to leave."""
        name, *args = line.split(None, 2)
        try:
            if name in (".quit", ".exit"):
                return True
            if name == ".tables":
                self.say("\n".join(f"{n}{f' ({k})' if k in ('view', 'mem', 'mem, persistent') else ''}" for n, k in self.engine.names().items()))
            elif name == ".sources":
                self.say("\n".join(f"{n}\t{k}" for n, k in self.engine.names().items()))
            elif name == ".schema":
                self.say("\n".join(f"{n} {t}" for n, t in self.engine.schema(args[0])))
            elif name == ".functions":
                self.say("\n".join(sorted({*scalar.SCALARS, *aggregates.AGGREGATES, *windows.NAMES})))
            elif name == ".use":
                self.engine.register(args[0], args[1])
            elif name == ".output":
                if args[0] not in render.FORMATS:
                    raise ValueError(f"there are {', '.join(render.FORMATS)}")
                self.how = args[0]
            elif name == ".explain":
                self.explain = not args or args[0] == "on"
            elif name == ".strict":
                self.engine.strict = not args or args[0] == "on"
            else:
                self.say(HELP)
        except IndexError:
            self.say(HELP)
        except Exception as e:
            self.say(f"error: {str(e).splitlines()[0]}")
        return False
