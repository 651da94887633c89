"""SQLite tables as a Python data source: filters go to the database as bound parameters, and Spark applies them again."""

from __future__ import annotations

import contextlib
import datetime
import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

KINDS = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"), ("TIMESTAMP", "timestamp_ntz"), ("DATETIME", "timestamp_ntz"), ("DATE", "timestamp_ntz"), ("NUM", "double"), ("DEC", "double"))


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkloom_sqlite"

    def _from(self) -> str:
        return f"({self.options['query']})" if "query" in self.options else _quote(self.options["table"])

    def schema(self) -> str:
        with contextlib.closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)) as db:
            if "table" in self.options:
                cols = [(r[1], (r[2] or "").upper()) for r in db.execute(f"PRAGMA table_info({_quote(self.options['table'])})")]
            else:
                at = db.execute(f"SELECT * FROM {self._from()} LIMIT 1")
                row = at.fetchone() or []
                cols = [(d[0], {int: "INT", float: "REAL", bytes: "BLOB"}.get(type(v), "TEXT")) for d, v in zip(at.description, [*row, *[None] * len(at.description)], strict=False)]
        return ", ".join(f"`{n}` {next((k for word, k in KINDS if word in t), 'string')}" for n, t in cols)

    def reader(self, schema):
        kind = PushingReader if self.options.get("push") == "true" else SqliteReader
        return kind(self.options["path"], self._from(), schema, "table" in self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, path, source, schema, table):
        self.path, self.source, self.schema, self.table = path, source, schema, table
        self.where, self.values = [], []

    def partitions(self):
        """Ranges of row numbers where the table has them."""
        if not self.table:
            return [InputPartition(None)]
        try:
            with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.source}").fetchone()
        except sqlite3.OperationalError:  # a view, or WITHOUT ROWID
            return [InputPartition(None)]
        if low is None or high - low < 100_000:
            return [InputPartition(None)]
        step = -(-(high - low + 1) // 16)
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition):
        where, values = list(self.where), list(self.values)
        if partition.value:
            where.append("rowid BETWEEN ? AND ?")
            values += partition.value
        names = ", ".join(_quote(f.name) for f in self.schema)
        kinds = [f.dataType.typeName() for f in self.schema]
        with contextlib.closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            for row in db.execute(f"SELECT {names} FROM {self.source}" + (f" WHERE {' AND '.join(where)}" if where else ""), values):
                yield tuple(_value(v, k) for v, k in zip(row, kinds, strict=True))


class PushingReader(SqliteReader):
    """The same where the session lets Python sources see filters."""

    def pushFilters(self, filters):
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        kinds = {f.name: f.dataType.typeName() for f in self.schema}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = name and kinds.get(name) in ("long", "double", "string")
            if plain and type(f) in ops and isinstance(f.value, (int, float, str)):
                self.where.append(f"{_quote(name)} {ops[type(f)]} ?")
                self.values.append(f.value)
            elif plain and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append(f"{_quote(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif name and isinstance(f, IsNull):
                self.where.append(f"{_quote(name)} IS NULL")
            elif name and isinstance(f, IsNotNull):
                self.where.append(f"{_quote(name)} IS NOT NULL")
            elif plain and isinstance(f, StringStartsWith):
                self.where.append(f"substr({_quote(name)}, 1, ?) = ?")
                self.values += [len(f.value), f.value]
            yield f  # and again by Spark


def _value(v, kind):
    if v is None:
        return None
    try:
        if kind == "timestamp_ntz":
            if isinstance(v, (int, float)):
                return datetime.datetime.fromtimestamp(v, datetime.UTC).replace(tzinfo=None)
            t = datetime.datetime.fromisoformat(str(v).replace("Z", "+00:00"))
            return t.astimezone(datetime.UTC).replace(tzinfo=None) if t.tzinfo else t
        return {"long": int, "double": float, "string": str, "boolean": bool}.get(kind, lambda x: x)(v)
    except (TypeError, ValueError):
        return None
