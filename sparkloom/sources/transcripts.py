"""Transcripts of assistant sessions: a JSON object a line, as rows of messages, tool calls or tool results.

The shape option (messages, tools, tool_results) picks the rows. Costs are estimates: tokens by a table of prices a million,
which the prices option replaces (JSON: model prefix to [input, output, cache write, cache read]).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tree import DialectError
from . import Spec, located, opener

CONTENT = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
SHAPE = f"struct<type:string,uuid:string,parentUuid:string,sessionId:string,timestamp:string,cwd:string,gitBranch:string,message:struct<role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>>"


def shaped(lines: DataFrame, shape: str, prices: dict[str, list[float]]) -> DataFrame:
    r = lines.select(F.from_json("value", SHAPE).alias("r")).filter("r.message IS NOT NULL").select("r.*")
    parts = F.from_json("message.content", CONTENT)
    common = [F.col("sessionId").alias("session_id"), F.col("uuid"), F.to_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("message.role").alias("role"), F.col("message.model").alias("model")]
    if shape == "messages":
        use = F.col("message.usage")
        texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
        cost = F.lit(None).cast("double")
        for model, (i, o, w, c) in sorted(prices.items(), key=lambda x: len(x[0])):
            each = sum((F.coalesce(use[k], F.lit(0)) * p for k, p in (("input_tokens", i), ("output_tokens", o), ("cache_creation_input_tokens", w), ("cache_read_input_tokens", c))), F.lit(0.0)) / 1e6
            cost = F.when(F.col("message.model").startswith(model), each).otherwise(cost)
        return r.select(*common, F.col("type"), F.col("parentUuid").alias("parent_uuid"), F.col("cwd"), F.col("gitBranch").alias("git_branch"), F.coalesce(F.nullif(texts, F.lit("")), F.when(~F.col("message.content").startswith("["), F.col("message.content"))).alias("text"), use["input_tokens"].alias("input_tokens"), use["output_tokens"].alias("output_tokens"), use["cache_creation_input_tokens"].alias("cache_write_tokens"), use["cache_read_input_tokens"].alias("cache_read_tokens"), cost.alias("cost_usd"))
    each = r.select(*common, F.explode(parts).alias("p"))
    if shape == "tools":
        return each.filter("p.type = 'tool_use'").select("session_id", "uuid", "timestamp", "model", F.col("p.id").alias("tool_id"), F.col("p.name").alias("tool"), F.col("p.input").alias("input"))
    if shape == "tool_results":
        return each.filter("p.type = 'tool_result'").select("session_id", "uuid", "timestamp", F.col("p.tool_use_id").alias("tool_id"), F.coalesce("p.is_error", F.lit(False)).alias("is_error"), F.col("p.content").alias("content"))
    raise DialectError(f"unknown shape {shape}")


@opener("transcripts", "claudelogs")
def transcripts(spark: SparkSession, spec: Spec, base: str) -> DataFrame:
    return shaped(spark.read.text(located(spec.path, base)), spec.options.get("shape", "messages"), json.loads(spec.options.get("prices", "{}")))
