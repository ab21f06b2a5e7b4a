"""Rate-limited remote lookups: each partition is a worker with its share of the global rate."""

from __future__ import annotations

import base64
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import quoted
from ..functions.text import json_first_number
from ..session import materialize


def basic_auth(user_variable: str, password_variable: str) -> dict[str, str]:
    """Headers from two environment variables of the driver, {} if either is unset; they never appear in a plan."""
    user, password = os.environ.get(user_variable), os.environ.get(password_variable)
    if not user or not password:
        return {}
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()}


def http_get(headers: dict[str, str] | None = None, timeout: float = 20.0) -> Callable[[str], tuple[int, str]]:
    """A fetch function: address -> (status, body). Statuses that are no success are returned, not raised."""

    def fetch(url: str) -> tuple[int, str]:
        from urllib import error, request

        try:
            with request.urlopen(request.Request(url, headers=headers or {}), timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")

    return fetch


def fetch_rows(df: DataFrame, fetch: Callable[[str], tuple[int, str]], url: str = "url", rate: float = 3.0, workers: int = 4, tries: int = 3, backoff: float = 0.5, pause: float = 0.0, name: str = "lookups") -> DataFrame:
    """df with sst_wmts, status, latency_ms, attempts and error.

    At most `rate` requests a second over all workers; up to `tries` tries, `backoff` x n seconds apart, only after
    exceptions. A value is taken only from a 2xx response with a number in its JSON. Failed requests stay in, with their
    error. Results are written once, in the shared folder, so that no later action repeats a request.
    """
    made = [T.StructField("body", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("latency_ms", T.LongType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *made])
    gap = workers / rate if rate else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for b in batches:
            rows = []
            for u in b[url]:
                body = status = problem = None
                n, took = 0, 0
                while n < tries:
                    n += 1
                    wait = last + max(gap, pause) - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last = begun = time.monotonic()
                    try:
                        status, body = fetch(u)
                        problem = None
                    except Exception as e:  # noqa: BLE001 - any failure of the client is a failed request
                        problem = f"{type(e).__name__}: {e}"
                    took = int((time.monotonic() - begun) * 1000)
                    if problem is None:
                        break
                    if n < tries:
                        time.sleep(backoff * n)
                rows.append((body, status, took, n, problem))
            out = pd.DataFrame(rows, columns=[f.name for f in made], index=b.index)
            out["status"] = out["status"].astype("Int32")
            yield pd.concat([b, out], axis=1)

    done = df.repartition(workers).mapInPandas(run, schema)
    ok = F.col("status").between(200, 299)
    out = done.withColumn("sst_wmts", F.when(ok, json_first_number(F.col("body")))).drop("body")
    return materialize(out.select(*[quoted(c) for c in df.columns], "sst_wmts", "status", "latency_ms", "attempts", "error"), name)
