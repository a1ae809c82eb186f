"""Remote embedding jobs: texts packed into requests, requests into files, and results joined back."""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_requests(rows: DataFrame, id_col: str, text_col: str, inputs: int, max_bytes: int, block: int = 10_000) -> DataFrame:
    """(id, request, place): running counts and sizes, in order of a whole-number id, that start anew when either
    bound would be passed and with each ``block`` of ids; a text above the bound is a request of its own.

    A request's number is its block's and its place there, so that the same rows always make the same
    requests, however they are split. Sizes travel, texts don't.
    """
    sized = rows.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n"), F.floor(F.col(id_col) / block).cast("long").alias("block"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        at, request, count, size = None, 0, 0, 0
        for frame in frames:
            out = []
            for key, n, own in zip(frame["id"], frame["n"], frame["block"]):
                if own != at:
                    at, request, count, size = own, own << 20, 0, 0
                if count and (count == inputs or size + n > max_bytes):
                    request, count, size = request + 1, 0, 0
                out.append((key, request, count))
                count, size = count + 1, size + n
            yield pd.DataFrame(out, columns=[id_col, "request", "place"])

    kind = rows.schema[id_col].dataType.simpleString()
    return sized.repartition(parts, "block").sortWithinPartitions("block", "id").mapInPandas(run, f"{id_col} {kind}, request long, place int")


def request_lines(rows: DataFrame, packed: DataFrame, id_col: str, text_col: str, model: str, dimensions: int | None = None) -> DataFrame:
    """One JSON line a request: custom_id, method, url and the body with its inputs in order."""
    gathered = rows.select(id_col, text_col).join(packed, id_col).groupBy("request").agg(F.sort_array(F.collect_list(F.struct("place", F.col(text_col).alias("input")))).alias("r"))
    body = {"model": F.lit(model), "input": F.col("r.input"), "encoding_format": F.lit("base64")} | ({"dimensions": F.lit(dimensions)} if dimensions else {})
    line = F.to_json(F.struct(F.concat(F.lit("request-"), "request").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), F.struct(*[v.alias(k) for k, v in body.items()]).alias("body")))
    return gathered.select("request", line.alias("value"))


def _vector(value) -> list[float]:
    return np.frombuffer(base64.b64decode(value), "<f4").tolist() if isinstance(value, str) else [float(x) for x in value]


def read_results(lines: DataFrame, packed: DataFrame, id_col: str) -> DataFrame:
    """(id, embedding, error) from result lines (column ``value``); a failed request is an error of all its
    texts, and one without a line says so."""
    schema = T.StructType([T.StructField("request", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(frames):
        for frame in frames:
            out = []
            for line in frame["value"]:
                found = json.loads(line)
                request = int(found["custom_id"].removeprefix("request-"))
                response = found.get("response") or {}
                if response.get("status_code") == 200:
                    out += [(request, x["index"], _vector(x["embedding"]), None) for x in response["body"]["data"]]
                else:
                    out.append((request, None, None, str(found.get("error") or response.get("status_code"))))
            yield pd.DataFrame(out, columns=["request", "place", "embedding", "error"]).astype({"place": "Int32"})

    found = lines.select("value").mapInPandas(run, schema)
    good = packed.join(found.where("error is null").drop("error"), ["request", "place"], "left")
    bad = found.where("error is not null").groupBy("request").agg(F.min("error").alias("error"))
    return good.join(bad, "request", "left").select(id_col, "embedding", F.when(F.col("embedding").isNull(), F.coalesce("error", F.lit("no result"))).alias("error"))


def job_status(items: DataFrame) -> DataFrame:
    """By job: items by status, and whether all have ended."""
    ended = F.col("status").isin("completed", "failed", "cancelled", "expired")
    return items.groupBy("job_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_and(ended).alias("terminal"))
