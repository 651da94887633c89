"""JSON over HTTP, and services that answer in it.

http: fetches one URL (method, body, bearer and header_NAME options; path: dotted place of the array). The services below are
the same fetch with their own address, request and shape; each takes an endpoint option, so they can be pointed at a local
server. A request is made by one executor task, which follows it page by page; what it returns is rows. Services that need a
client library are read by an executor task likewise.
"""

from __future__ import annotations

import base64
import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.tree import DialectError
from . import Spec, opener
from .files import json_rows

TIMEOUT = 30


def fetch(url: str, options: dict) -> object:
    return asked(url, options)[0]


def asked(url: str, options: dict) -> tuple[object, dict[str, str]]:
    """The answer, and its headers by their names in lower case."""
    headers = {"Accept": "application/json"} | {k[len("header_") :].replace("_", "-"): v for k, v in options.items() if k.startswith("header_")}
    if options.get("bearer"):
        headers["Authorization"] = f"Bearer {options['bearer']}"
    elif options.get("user"):
        headers["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()
    body = options.get("body")
    if body:
        headers.setdefault("Content-Type", "application/json")
    request = urllib.request.Request(url, body.encode() if body else None, headers, method=options.get("method", "POST" if body else "GET").upper())
    with urllib.request.urlopen(request, timeout=TIMEOUT) as r:
        return json.loads(r.read()), {k.lower(): v for k, v in r.headers.items()}


def at(value: object, path: str | None) -> list:
    """The records at a dotted place; scalars become {value: ...}."""
    for step in filter(None, (path or "").split(".")):
        value = value[int(step)] if isinstance(value, list) else (value or {}).get(step)
    rows = value if isinstance(value, list) else [] if value is None else [value]
    return [r if isinstance(r, dict) else {"value": r} for r in rows]


Shape = Callable[[object], Iterable[dict]]
#: From a request's url, options, answer and headers to the url and options of the next page, or None.
More = Callable[[str, dict, object, dict], tuple[str, dict] | None]


def fetched(spark: SparkSession, jobs: list[tuple[str, dict]], shape: Shape, more: More | None = None) -> DataFrame:
    """json_rows of what shape makes of each answer and of the pages after it; one task for each request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for url, text in zip(df["url"], df["options"], strict=True):
                page = (url, json.loads(text))
                while page:
                    answer, headers = asked(*page)
                    yield pd.DataFrame({"value": [json.dumps(r) for r in shape(answer)]}, dtype=object)
                    page = more(*page, answer, headers) if more else None

    requests = spark.createDataFrame([(u, json.dumps(o)) for u, o in jobs], "url string, options string").repartition(len(jobs))
    return json_rows(requests.mapInPandas(run, "value string").cache())


def _body(options: dict, /, **new: object) -> dict:
    """Options with these entries in the request's body."""
    return options | {"body": json.dumps(json.loads(options["body"]) | new)}


@opener("http", "https")
def http(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    url = spec.path if spec.path.startswith("http") else f"{spec.prefix}:{spec.path}"
    path = spec.options.get("path")
    return fetched(spark, [(url, spec.options)], lambda answer: at(answer, path))


def _endpoint(spec: Spec, default: str) -> str:
    return spec.options.get("endpoint", default).rstrip("/")


@opener("prom")
def prom(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """A range query: ts, a column for each label, value. The step is a 250th of the window, 15 seconds at least."""
    end = float(spec.options.get("end") or time.time())
    start = float(spec.options.get("start") or end - 3600)
    step = spec.options.get("step") or max(15, math.ceil((end - start) / 250))
    query = urllib.parse.urlencode({"query": spec.path, "start": start, "end": end, "step": step})

    def shape(answer):
        for series in answer["data"]["result"]:
            labels = {("name" if k == "__name__" else k): v for k, v in series["metric"].items()}
            for t, v in series.get("values") or [series["value"]]:
                x = float(v)
                yield labels | {"ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(float(t))), "value": x if math.isfinite(x) else None}

    return fetched(spark, [(f"{_endpoint(spec, 'http://localhost:9090')}/api/v1/query_range?{query}", spec.options)], shape).withColumn("ts", _ts("ts"))


def _ts(name: str):
    from pyspark.sql import functions as F

    return F.col(name).cast("timestamp_ntz")


#: The services' own addresses, and for each the request of a dataset and where its records stand.
GRAPHQL = {"issues": "id identifier title priority createdAt updatedAt state { name } assignee { name } team { key }", "teams": "id key name", "projects": "id name state progress", "users": "id name email active"}


def _flat(r: dict) -> dict:
    """Nested objects of one level as parent_child."""
    out = {}
    for k, v in r.items():
        if isinstance(v, dict):
            out |= {f"{k}_{a}": b for a, b in v.items() if not isinstance(b, (dict, list))}
        else:
            out[k] = v
    return out


@opener("linear")
def linear(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    if spec.path not in GRAPHQL:
        raise DialectError(f"linear: has {', '.join(GRAPHQL)}")
    what = spec.path
    query = f"query($after: String) {{ {what}(first: 100, after: $after) {{ nodes {{ {GRAPHQL[what]} }} pageInfo {{ hasNextPage endCursor }} }} }}"
    options = {"header_Authorization": spec.options.get("api_key", ""), "body": json.dumps({"query": query, "variables": {}})} | spec.options

    def more(url, options, answer, headers):
        info = answer["data"][what].get("pageInfo") or {}
        return (url, _body(options, variables={"after": info["endCursor"]})) if info.get("hasNextPage") else None

    return fetched(spark, [(_endpoint(spec, "https://api.linear.app/graphql"), options)], lambda a: map(_flat, a["data"][what]["nodes"]), more)


@opener("trello")
def trello(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    what, _, board = spec.path.partition("/")
    if what not in ("boards", "lists", "cards", "members"):
        raise DialectError("trello: has boards, lists/BOARD, cards/BOARD and members/BOARD")
    keys = urllib.parse.urlencode({"key": spec.options.get("key", ""), "token": spec.options.get("token", "")})
    place = "members/me/boards" if what == "boards" else f"boards/{board}/{what}"
    return fetched(spark, [(f"{_endpoint(spec, 'https://api.trello.com')}/1/{place}?{keys}", spec.options)], lambda a: map(_flat, a))


@opener("grafana")
def grafana(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """A data source's native query; frames are columns, and rows are what they align."""
    body = {"queries": [{"refId": "A", "datasource": {"uid": spec.options.get("datasource", "")}, "expr": spec.path, "rawSql": spec.path, "format": "table"}], "from": spec.options.get("from", "now-1h"), "to": spec.options.get("to", "now")}

    def shape(answer):
        for result in answer["results"].values():
            for f in result.get("frames", []):
                names = [x["name"] for x in f["schema"]["fields"]]
                for row in zip(*f["data"]["values"], strict=True):
                    yield dict(zip(names, row, strict=True))

    return fetched(spark, [(f"{_endpoint(spec, 'http://localhost:3000')}/api/ds/query", {"body": json.dumps(body)} | spec.options)], shape)


@opener("honeycomb")
def honeycomb(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """datasets, columns/DATASET, markers/DATASET, or a result/DATASET/ID of a query; raw events can't be read."""
    what, _, rest = spec.path.partition("/")
    root = f"{_endpoint(spec, 'https://api.honeycomb.io')}/1"
    options = {"header_X-Honeycomb-Team": spec.options.get("api_key", "")} | spec.options
    if what == "datasets":
        return fetched(spark, [(f"{root}/datasets", options)], lambda a: map(_flat, a))
    if what in ("columns", "markers"):
        return fetched(spark, [(f"{root}/{what}/{rest}", options)], lambda a: map(_flat, a))
    if what == "result":
        return fetched(spark, [(f"{root}/query_results/{rest}", options)], lambda a: [r["data"] for r in a["data"]["results"]])
    raise DialectError("honeycomb: has datasets, columns/..., markers/... and result/...; events can only be aggregated")


@opener("azuredevops")
def azuredevops(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """Work items by a WIQL condition (where option) in organisation/project."""
    root = f"{_endpoint(spec, 'https://dev.azure.com')}/{spec.path}/_apis/wit"
    options = {"user": "", "password": spec.options.get("token", "")} | spec.options
    wiql = "SELECT [System.Id] FROM WorkItems" + (f" WHERE {spec.options['where']}" if "where" in spec.options else "")
    ids = [w["id"] for w in fetch(f"{root}/wiql?api-version=7.0", options | {"body": json.dumps({"query": wiql})})["workItems"]]
    jobs = [(f"{root}/workitems?api-version=7.0&ids={','.join(map(str, ids[i : i + 200]))}", options) for i in range(0, len(ids), 200)]
    short = lambda k: k.rsplit(".", 1)[-1].lower()
    return fetched(spark, jobs, lambda a: [{"id": w["id"]} | {short(k): (v.get("displayName") if isinstance(v, dict) else v) for k, v in w["fields"].items()} for w in a["value"]]) if jobs else spark.createDataFrame([], "id bigint")


def _azure(prefix: str, place, body, records, more: More | None = None) -> None:
    @opener(prefix)
    def open_(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
        root = _endpoint(spec, "https://api.loganalytics.azure.com" if prefix == "azlogs" else "https://management.azure.com")
        request = body(spec)
        return fetched(spark, [(root + place(spec), ({"body": json.dumps(request)} if request else {}) | spec.options)], records, more)


def _table(columns: list, rows: list) -> Iterator[dict]:
    names = [c["name"] for c in columns]
    return (dict(zip(names, r, strict=True)) for r in rows)


def _metric_rows(a: dict) -> Iterator[dict]:
    for m in a["value"]:
        for series in m["timeseries"]:
            dims = {d["name"]["value"]: d["value"] for d in series.get("metadatavalues", [])}
            for p in series["data"]:
                for k, v in p.items():
                    if k != "timeStamp":
                        yield dims | {"timestamp": p["timeStamp"], "resource": m.get("id"), "metric": m["name"]["value"], "unit": m.get("unit"), "aggregation": k, "value": v}


def _skip(url: str, options: dict, answer: object, headers: dict) -> tuple[str, dict] | None:
    token = answer.get("$skipToken")
    return (url, _body(options, options={"resultFormat": "objectArray", "$skipToken": token})) if token else None


_azure("azrgraph", lambda s: "/providers/Microsoft.ResourceGraph/resources?api-version=2022-10-01", lambda s: {"query": s.path, "options": {"resultFormat": "objectArray"}}, lambda a: a["data"], _skip)
_azure("azlogs", lambda s: f"/v1/workspaces/{s.options.get('workspace', '')}/query", lambda s: {"query": s.path, **({"timespan": s.options["timespan"]} if "timespan" in s.options else {})}, lambda a: _table(a["tables"][0]["columns"], a["tables"][0]["rows"]))
_azure("azmetrics", lambda s: f"{s.path}/providers/microsoft.insights/metrics?" + urllib.parse.urlencode({"api-version": "2023-10-01", "metricnames": s.options.get("metric", ""), "aggregation": s.options.get("aggregation", "Average"), **{k: s.options[k] for k in ("timespan", "interval", "$filter") if k in s.options}}), lambda s: None, _metric_rows)
_azure("azcost", lambda s: f"/{s.path}/providers/Microsoft.CostManagement/query?api-version=2023-11-01", lambda s: {"type": "ActualCost", "timeframe": s.options.get("timeframe", "MonthToDate"), "dataset": {"granularity": s.options.get("granularity", "Daily"), "aggregation": {"totalCost": {"name": "Cost", "function": "Sum"}}, "grouping": [{"type": "Dimension", "name": g} for g in s.options.get("group", "").split(",") if g]}}, lambda a: _table(a["properties"]["columns"], a["properties"]["rows"]), lambda url, options, answer, headers: (link, options) if (link := answer["properties"].get("nextLink")) else None)


@opener("azuretables")
def azuretables(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    """Entities of a table; $filter is passed as the filter option, sas as the query's signature."""
    query = "&".join(x for x in (urllib.parse.urlencode({"$filter": spec.options["filter"]}) if "filter" in spec.options else "", spec.options.get("sas", "")) if x)
    first = f"{_endpoint(spec, '')}/{spec.path}()?{query}"

    def more(url, options, answer, headers):
        keys = {k: headers[f"x-ms-continuation-{k.lower()}"] for k in ("NextPartitionKey", "NextRowKey") if f"x-ms-continuation-{k.lower()}" in headers}
        return (first + "&" * (not first.endswith("?")) + urllib.parse.urlencode(keys), options) if keys else None

    return fetched(spark, [(first, {"header_Accept": "application/json;odata=nometadata"} | spec.options)], lambda a: a["value"], more)


def _aws(prefix: str, call) -> None:
    """Services of one cloud by its client library, where that is installed; the region and profile come from its own settings."""

    @opener(prefix)
    def open_(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
        try:
            import boto3
        except ImportError:
            raise DialectError(f"{prefix}: needs boto3, which isn't installed") from None
        del boto3  # each task has its own

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import boto3

            for _ in batches:
                rows = iter(call(boto3, spec))
                while page := [json.dumps(r, default=str) for r in islice(rows, 1000)]:
                    yield pd.DataFrame({"value": page}, dtype=object)

        return json_rows(spark.range(1, numPartitions=1).mapInPandas(run, "value string").cache())


def _pages(client, name: str, key: str, **args):
    for page in client.get_paginator(name).paginate(**args):
        yield from page[key]


def _untyped(item: dict) -> dict:
    from boto3.dynamodb.types import TypeDeserializer

    return {k: TypeDeserializer().deserialize(v) for k, v in item.items()}


def _athena(boto3, spec: Spec):
    client = boto3.client("athena")
    run = client.start_query_execution(QueryString=spec.options.get("query", f"SELECT * FROM {spec.path}"), QueryExecutionContext={"Database": spec.options.get("database", "default")}, **({"ResultConfiguration": {"OutputLocation": spec.options["output"]}} if "output" in spec.options else {}))["QueryExecutionId"]
    while (state := client.get_query_execution(QueryExecutionId=run)["QueryExecution"]["Status"]["State"]) in ("QUEUED", "RUNNING"):
        time.sleep(1)
    if state != "SUCCEEDED":
        raise DialectError(f"the query ended as {state}")
    names = None
    for row in (r for page in client.get_paginator("get_query_results").paginate(QueryExecutionId=run) for r in page["ResultSet"]["Rows"]):
        values = [c.get("VarCharValue") for c in row["Data"]]
        if names is None:
            names = values
        else:
            yield dict(zip(names, values, strict=True))


def _metrics(boto3, spec: Spec):
    namespace, _, metric = spec.path.partition("/")
    end = float(spec.options.get("end") or time.time())
    query = {"Id": "q", "MetricStat": {"Metric": {"Namespace": spec.options.get("namespace", namespace), "MetricName": metric}, "Period": int(spec.options.get("period", 300)), "Stat": spec.options.get("stat", "Average")}}
    for r in _pages(boto3.client("cloudwatch"), "get_metric_data", "MetricDataResults", MetricDataQueries=[query], StartTime=float(spec.options.get("start") or end - 3600), EndTime=end):
        for t, v in zip(r["Timestamps"], r["Values"], strict=True):
            yield {"timestamp": t.isoformat(), "namespace": namespace, "metric": metric, "stat": query["MetricStat"]["Stat"], "value": v, "label": r["Label"], "status": r["StatusCode"]}


def _cost(boto3, spec: Spec):
    start, _, end = spec.path.partition("/")
    groups = [{"Type": "DIMENSION", "Key": g} for g in spec.options.get("group", "").split(",") if g]
    client, token, results = boto3.client("ce"), {}, []
    while True:
        answer = client.get_cost_and_usage(TimePeriod={"Start": start, "End": end}, Granularity=spec.options.get("granularity", "DAILY"), Metrics=["UnblendedCost"], GroupBy=groups, **token)
        results += answer["ResultsByTime"]
        if not answer.get("NextPageToken"):
            break
        token = {"NextPageToken": answer["NextPageToken"]}
    for p in results:
        for g in p["Groups"] or [{"Keys": [], "Metrics": p["Total"]}]:
            yield {"period_start": p["TimePeriod"]["Start"], "period_end": p["TimePeriod"]["End"], "estimated": p["Estimated"], "amount": float(g["Metrics"]["UnblendedCost"]["Amount"])} | {d["Key"].lower(): k for d, k in zip(groups, g["Keys"], strict=True)}


_aws("dynamodb", lambda b, s: map(_untyped, _pages(b.client("dynamodb"), "scan", "Items", TableName=s.path)))
_aws("cloudwatchlogs", lambda b, s: ({"timestamp": e["timestamp"], "message": e["message"], "log_stream": e["logStreamName"], "event_id": e["eventId"], "ingestion_time": e["ingestionTime"]} for e in _pages(b.client("logs"), "filter_log_events", "events", logGroupName=s.path, **({"filterPattern": s.options["filter"]} if "filter" in s.options else {}))))
_aws("cloudwatch", _metrics)
_aws("awsconfig", lambda b, s: map(json.loads, _pages(b.client("config"), "select_resource_config", "Results", Expression=s.path)))
_aws("awscost", _cost)
_aws("athena", _athena)
