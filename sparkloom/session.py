"""The engine: named sources, views and materialized views, and statements of the dialect over them.

An engine takes the caller's SparkSession and leaves its settings as they are; session() makes one with what the engine
works best with. A view is its text, compiled anew wherever it is named. A materialized view is rows: cached for the
session, or Parquet with its definition beside it, which a later engine with the same folder finds again.
"""

from __future__ import annotations

import datetime
import json
import os
import re
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import sources
from .plans import tree as T
from .plans.compiler import Compiler, Query
from .plans.parser import parse
from .plans.tree import DialectError


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true", "spark.ui.enabled": "false"} | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


@dataclass
class MaterializedView:
    text: str
    view: str | None = None
    frame: DataFrame | None = None
    path: str | None = None
    created: str = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).isoformat())

    @property
    def populated(self) -> bool:
        return self.view is not None


@dataclass
class Result:
    """What a statement gave: rows, or a notice."""

    frame: DataFrame | None = None
    notice: str = ""
    columns: list = field(default_factory=list)


class Engine:
    def __init__(self, spark: SparkSession | None = None, base: str = ".", store: str | None = None, strict: bool = False, asof_bins: int = 0):
        self.spark = spark or session()
        self.base, self.store, self.strict = base, store, strict
        self.asof_bins = asof_bins  # ranges of time that as-of joins with keys are cut into, for keys with very many rows
        self.tables: dict[str, str] = {}
        self.specs: dict[str, sources.Spec] = {}
        self.views: dict[str, str] = {}
        self.mats: dict[str, MaterializedView] = {}
        self._views_open: list[str] = []
        self._passing: list[str] = []  # temporary views of inlined views, until the query that names them is a DataFrame
        self._id = uuid.uuid4().hex[:12]
        self._n = 0
        self.warnings: list[str] = []

    # names
    def _temp(self, df: DataFrame) -> str:
        self._n += 1
        name = f"__e{self._id}_{self._n}"
        df.createOrReplaceTempView(name)
        return name

    def _free(self, name: str) -> None:
        for what, names in (("source", {*self.tables, *self.specs}), ("view", self.views), ("materialized view", self.mats)):
            if name.lower() in names:
                raise DialectError(f"there is a {what} {name} already")

    def register(self, name: str, source: DataFrame | sources.Spec | str, **options: str) -> None:
        """A DataFrame, a spec, or 'prefix:path' under a name. Specs are opened when they are first named."""
        key = name.lower()
        if key in self.views or key in self.mats:
            self._free(name)
        self.tables.pop(key, None)
        self.specs.pop(key, None)
        if isinstance(source, DataFrame):
            self.tables[key] = self._temp(source)
        else:
            self.specs[key] = source if isinstance(source, sources.Spec) else sources.Spec.of(source, options)

    def drop_source(self, name: str) -> None:
        if self.tables.pop(name.lower(), None) is None and self.specs.pop(name.lower(), None) is None:
            raise DialectError(f"no source {name}")

    def names(self) -> dict[str, str]:
        """Every name that can stand in FROM, and what it is."""
        out = {n: "table" for n in self.tables} | {n: s.prefix for n, s in self.specs.items()} | dict.fromkeys(self.views, "view")
        return dict(sorted((out | {n: "mem, persistent" if m.path else "mem" for n, m in self.mats.items()}).items()))

    def _load(self, prefix: str | None, name: str) -> str:
        key = name.lower()
        if prefix == "mem":  # a materialized view by its prefix
            if key not in self.mats:
                raise DialectError(f"no materialized view {name}")
            prefix = None
        if prefix is not None:
            key = f"{prefix}:{name}"
            if key not in self.tables:
                self.tables[key] = self._temp(sources.load(self.spark, sources.Spec(prefix, name), self.base))
            return self.tables[key]
        if key in self.views:
            if key in self._views_open:
                raise DialectError(f"view {name} refers to itself")
            self._views_open.append(key)
            try:
                df = self._frame(parse(self.views[key]))
            finally:
                self._views_open.pop()
            self._passing.append(self._temp(df))
            return self._passing[-1]
        if key in self.mats:
            if not self.mats[key].populated:
                raise DialectError(f"materialized view {name} has no data; REFRESH it")
            return self.mats[key].view
        if key in self.tables:
            return self.tables[key]
        if key in self.specs:
            self.tables[key] = self._temp(sources.load(self.spark, self.specs[key], self.base))
            return self.tables[key]
        raise DialectError(f"no source {name}")

    # queries
    def _compile(self, q: object) -> tuple[Query, Compiler]:
        compiler = Compiler(self.spark, self._load, self.strict, self.asof_bins)
        return compiler.compile(q), compiler

    def _resolved(self, q: object, only_checked: bool = False) -> tuple[DataFrame | None, Query]:
        """A parsed query as a DataFrame; the temporary views on the way are dropped, for a DataFrame holds their plans."""
        mark = len(self._passing)
        try:
            compiled, compiler = self._compile(q)
            df = None if only_checked else self.spark.sql(compiled.sql)
            compiler.close()
        finally:
            while len(self._passing) > mark:
                self.spark.catalog.dropTempView(self._passing.pop())
        return df, compiled

    def _frame(self, q: object) -> DataFrame:
        df, compiled = self._resolved(q)
        names = Compiler._unique([n for n, _ in compiled.columns])
        return df.toDF(*names) if names != df.columns else df

    def query(self, text: str) -> DataFrame:
        """The rows of a query, lazily."""
        q = parse(text)
        if isinstance(q, T.Statement):
            raise DialectError("not a query")
        return self._resolved(q)[0]

    def sql_of(self, text: str) -> str:
        """The Spark SQL of a query."""
        return self._compile(parse(text))[0].sql

    def execute(self, text: str) -> Result:
        s = parse(text)
        if not isinstance(s, T.Statement):
            df, q = self._resolved(s)
            return Result(df, columns=q.columns)
        return Result(notice=getattr(self, "_" + s.action.replace(" ", "_"))(s))

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Spark's plan, in which PushedFilters, ReadSchema and the join strategies can be read."""
        df = self.query(text)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def schema(self, name: str) -> list[tuple[str, str]]:
        from .plans.compiler import kind_of

        prefix, _, path = name.partition(":")
        view = self._load(prefix, path) if path and prefix.isidentifier() else self._load(None, name)
        return [(n, kind_of(t)) for n, t in self.spark.table(view).dtypes]

    # views
    def _create_view(self, s: T.Statement) -> str:
        key = s.name.lower()
        if not (s.replace and key in self.views):
            self._free(s.name)
        old = self.views.get(key)
        self._views_open.append(key)
        try:
            self._resolved(parse(s.text), only_checked=True)
        finally:
            self._views_open.pop()
        self.views[key] = s.text
        return f"view {s.name} {'replaced' if old else 'created'}"

    def _drop_view(self, s: T.Statement) -> str:
        if self.views.pop(s.name.lower(), None) is None:
            if s.lenient:
                return f"no view {s.name}"
            raise DialectError(f"no view {s.name}")
        return f"view {s.name} dropped"

    def _create_matview(self, s: T.Statement) -> str:
        key = s.name.lower()
        if key in self.mats and s.lenient:
            return f"materialized view {s.name} is there already"
        self._free(s.name)
        m = MaterializedView(s.text)
        if s.persistent:
            if not re.fullmatch(r"\w+", s.name):
                raise DialectError(f"{s.name} can't be a file's name")
            m.path = os.path.join(self._store(), s.name.lower())
        df = self._definition(s.text)
        if s.data:
            self._fill(m, df)
        elif m.path:
            self._write(m, df.limit(0), False)
        self.mats[key] = m
        return f"materialized view {s.name} created" + ("" if s.data else " without data")

    def _definition(self, text: str) -> DataFrame:
        df, q = self._resolved(parse(text))
        names = [n.rsplit(".", 1)[-1] for n, _ in q.columns]
        low = [n.lower() for n in names]
        if twice := next((n for n in names if low.count(n.lower()) > 1), None):
            raise DialectError(f"column {twice} stands twice; name one of them with AS")
        return df.toDF(*names)

    def _fill(self, m: MaterializedView, df: DataFrame) -> None:
        if m.path:
            self._write(m, df, True)
            m.view = self._temp(self.spark.read.parquet(os.path.join(m.path, "rows")))
            return
        old, m.frame = m.frame, df.cache()
        m.frame.count()  # a snapshot of now
        m.view = self._temp(m.frame)
        if old is not None:
            old.unpersist()

    def _refresh_matview(self, s: T.Statement) -> str:
        m = self.mats.get(s.name.lower())
        if m is None:
            raise DialectError(f"no materialized view {s.name}")
        if s.data:
            self._fill(m, self._definition(m.text))
            return f"materialized view {s.name} refreshed"
        if m.frame is not None:
            m.frame.unpersist()
        m.view = m.frame = None
        if m.path:
            self._write(m, self._definition(m.text).limit(0), False)
        return f"materialized view {s.name} emptied"

    def _drop_matview(self, s: T.Statement) -> str:
        m = self.mats.pop(s.name.lower(), None)
        if m is None:
            if s.lenient:
                return f"no materialized view {s.name}"
            raise DialectError(f"no materialized view {s.name}")
        if m.frame is not None:
            m.frame.unpersist()
        if m.path:
            shutil.rmtree(m.path, ignore_errors=True)
        return f"materialized view {s.name} dropped"

    # the store of persistent views
    def _store(self) -> str:
        return self.store or os.path.join(self.base, ".sparkloom", "matviews")

    def _write(self, m: MaterializedView, df: DataFrame, populated: bool) -> None:
        """Written beside, then renamed, so a reader finds the old snapshot or the new one."""
        fresh = f"{m.path}.{uuid.uuid4().hex}"
        try:
            df.write.parquet(os.path.join(fresh, "rows"))
            m.created = datetime.datetime.now(datetime.UTC).isoformat()
            with open(os.path.join(fresh, "meta.json"), "w") as f:
                json.dump({"query": m.text, "created_at": m.created, "populated": populated, "schema": json.loads(df.schema.json())}, f)
            gone = f"{m.path}.old-{uuid.uuid4().hex}"
            if os.path.exists(m.path):
                os.rename(m.path, gone)
            os.rename(fresh, m.path)
            shutil.rmtree(gone, ignore_errors=True)
        finally:
            shutil.rmtree(fresh, ignore_errors=True)

    def reload(self) -> list[str]:
        """Take up the persistent views in the store; a name that a source has is left out, with a warning."""
        found = []
        folder = self._store()
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
            meta = os.path.join(folder, name, "meta.json")
            if not re.fullmatch(r"\w+", name) or not os.path.exists(meta):
                continue
            if name in self.tables or name in self.specs:
                self.warnings.append(f"persistent view {name} is left out: there is a source of that name")
                continue
            with open(meta) as f:
                said = json.load(f)
            m = MaterializedView(said["query"], path=os.path.join(folder, name), created=said["created_at"])
            if said["populated"]:
                m.view = self._temp(self.spark.read.parquet(os.path.join(m.path, "rows")))
            self.mats[name] = m
            found.append(name)
        return found
