"""Mining of log templates: lines are masked, clustered by their words, and each cluster becomes a pattern with named groups.

Executors mask and cluster all lines, each task its own, and give the driver their templates with counts; there, templates
are merged as lines are, so what a line's template is follows from all lines. The driver sees templates, not lines: at most
MOST of a task, the commonest; what a task has beyond counts as OTHER, and is told.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILAR = 0.5
#: What is variable wherever it stands, tried in this order.
MASKS = (
    ("time", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"), ("uuid", r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"), ("ip", r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?"),
    ("hex", r"0x[0-9a-fA-F]+|\b[0-9a-f]{16,}\b"), ("num", r"[+-]?\d+(?:\.\d+)?"), ("str", r'"[^"]*"'),
)
_ANY = re.compile("|".join(f"(?P<{n}>(?<![\\w.]){p}(?![\\w]))" if n not in ("str",) else f"(?P<{n}>{p})" for n, p in MASKS))


@dataclass
class Template:
    words: list  # a text, or None where it varies
    count: int
    examples: list

    def text(self) -> str:
        return " ".join("<*>" if w is None else w for w in self.words)

    def pattern(self) -> str:
        """A regular expression with a group for each variable part, named by the word before it."""
        out, n, last, used = [], 0, "", set()
        for w in self.words:
            if w is None:
                pieces = ["<*>"]
            else:
                pieces = re.split(r"(<(?:time|uuid|ip|hex|num|str)>)", w)
            sql = ""
            for piece in pieces:
                if piece == "<*>" or re.fullmatch(r"<(time|uuid|ip|hex|num|str)>", piece):
                    n += 1
                    name = re.sub(r"\W+", "_", last.strip("=:")).strip("_").lower() or f"f{n}"
                    name = name if re.match(r"[a-z]", name) and name not in used else f"{name}_{n}" if re.match(r"[a-z]", name) else f"f{n}"
                    used.add(name)
                    kind = piece[1:-1]
                    sql += f"(?P<{name}>{dict(MASKS).get(kind, r'.+?' if piece == '<*>' else r'.*?')})"
                else:
                    sql += re.escape(piece)
                    last = piece or last
            out.append(sql)
        return "^" + r"\s+".join(out) + "$"


def masked(line: str) -> str:
    return _ANY.sub(lambda m: f"<{m.lastgroup}>", line.strip())


def similarity(a: list, b: list) -> float:
    if len(a) != len(b):
        return 0.0
    return sum(x == y and x is not None for x, y in zip(a, b, strict=True)) / max(len(a), 1)


def mine(lines: list[str], least: float = SIMILAR) -> list[Template]:
    """Templates, the commonest first."""
    groups: dict[tuple, list[Template]] = {}
    for line in lines:
        words = masked(line).split()
        if not words:
            continue
        own = groups.setdefault((len(words), words[0] if not words[0].startswith("<") else ""), [])
        best = max(own, key=lambda t: similarity(t.words, words), default=None)
        if best is not None and similarity(best.words, words) >= least:
            best.words = [x if x == y else None for x, y in zip(best.words, words, strict=True)]
            best.count += 1
            if len(best.examples) < 3:
                best.examples.append(line)
        else:
            own.append(Template(words, 1, [line]))
    merged: dict[str, Template] = {}
    for t in (t for own in groups.values() for t in own):
        if (same := merged.get(t.text())) is not None:
            same.count += t.count
        else:
            merged[t.text()] = t
    return sorted(merged.values(), key=lambda t: (-t.count, t.text()))


def common(lines: list[str]) -> Template | None:
    """One template for all lines: words that all share in order, with anything between."""
    split = [masked(x).split() for x in lines if x.strip()]
    if not split:
        return None
    n = min(map(len, split))
    head = next((i for i in range(n) if len({tuple(s[: i + 1]) for s in split}) > 1), n)
    tail = next((i for i in range(n - head) if len({tuple(s[len(s) - i - 1 :]) for s in split}) > 1), n - head)
    words = split[0][:head] + ([] if all(len(s) == head + tail for s in split) else [None]) + (split[0][len(split[0]) - tail :] if tail else [])
    return Template(words, len(split), lines[:3])


def assign(lines: DataFrame, templates: list[Template], column: str = "value") -> DataFrame:
    """lines with the text of the first template each matches, by Spark's expressions; NULL if none."""
    out = F.lit(None).cast("string")
    for t in reversed(templates):
        out = F.when(F.col(column).rlike(re.sub(r"\(\?P<\w+>", "(", t.pattern())), t.text()).otherwise(out)
    return lines.withColumn("template", out)


#: Templates that one task may send.
MOST, OTHER = 10_000, "<other>"


def merged(found: list[Template], least: float = SIMILAR) -> list[Template]:
    """Templates of several tasks as one list: similar ones become one, the commonest first."""
    groups: dict[tuple, list[Template]] = {}
    for t in sorted(found, key=lambda t: (-t.count, t.text())):
        first = t.words[0] if t.words and t.words[0] is not None and not t.words[0].startswith("<") else ""
        own = groups.setdefault((len(t.words), first), [])
        best = max(own, key=lambda o: similarity(o.words, t.words), default=None)
        if best is not None and (best.words == t.words or similarity(best.words, t.words) >= least):
            best.words = [x if x == y else None for x, y in zip(best.words, t.words, strict=True)]
            best.count += t.count
            best.examples = (best.examples + t.examples)[:3]
        else:
            own.append(Template(list(t.words), t.count, t.examples[:3]))
    out: dict[str, Template] = {}
    for t in (t for own in groups.values() for t in own):
        if (same := out.get(t.text())) is not None:
            same.count += t.count
        else:
            out[t.text()] = t
    return sorted(out.values(), key=lambda t: (-t.count, t.text()))


def mined(lines: DataFrame, column: str = "value") -> list[Template]:
    """The templates of all lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[Template] = []
        for df in batches:
            found = merged(found + mine([x for x in df["line"] if x]))
        rest = sum(t.count for t in found[MOST:])
        rows = [([w or "" for w in t.words], t.count, t.examples) for t in found[:MOST]] + [([OTHER], rest, [])] * (rest > 0)
        yield pd.DataFrame(rows, columns=["words", "n", "examples"])

    rows = lines.select(F.col(column).alias("line")).mapInPandas(run, "words array<string>, n bigint, examples array<string>").collect()
    return merged([Template([w or None for w in r["words"]], r["n"], list(r["examples"])) for r in rows])


def count(lines: DataFrame, column: str = "value") -> DataFrame:
    """template, n over all lines."""
    found = [(t.text(), t.count) for t in mined(lines, column)]
    return lines.sparkSession.createDataFrame(found, "template string, n bigint")
