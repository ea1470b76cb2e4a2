"""Durable results of model calls, keyed by what was asked.

A ledger is an append-only table of request_id, a value of any type, and error.
The id is a hash of everything that was asked, the client's identity included,
so a changed text, setting or model is a new request, and an interrupted or
repeated job asks only what has no value yet. A request that failed has an error
row (its value may hold the parts that did not fail) and is asked again by the
next job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources.tables import exists


def identity(client: object) -> str:
    """Name under which a client's results are stored.

    A client class may name itself in ``identity`` (a model and its version,
    say); results of clients with one identity are taken as each other's.
    """
    named = getattr(client, "identity", None)
    return str(named) if named else f"{getattr(client, '__module__', '')}:{getattr(client, '__qualname__', type(client).__qualname__)}"


def request_key(client: object, stage: str, settings: str, *asked: Column) -> Column:
    """Hash of the client, the stage, its settings and the columns asked about."""
    named = [F.lit(identity(client)).alias("client"), F.lit(stage).alias("stage"), F.lit(settings).alias("params")]
    return F.md5(F.to_json(F.struct(*named, *asked)))


class Ledger:
    """The table at ``path``; ``value`` is the type of a result, ``name`` its column."""

    def __init__(self, spark: SparkSession, path: str, value: str | T.DataType = "string", name: str = "value"):
        kind = T._parse_datatype_string(value) if isinstance(value, str) else value
        self.spark, self.path, self.name = spark, path, name
        self.schema = T.StructType([
            T.StructField("request_id", T.StringType()), T.StructField(name, kind), T.StructField("error", T.StringType()),
        ])

    def load(self) -> DataFrame:
        """All rows, those of failed attempts included."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def missing(self, requests: DataFrame) -> DataFrame:
        """Requests without a whole result. The ids are unique, hence free of skew; a new ledger needs no join."""
        if not exists(self.spark, self.path):
            return requests
        done = self.load().where(F.col("error").isNull()).select("request_id")
        return requests.join(done, "request_id", "left_anti")

    def results(self) -> DataFrame:
        """One row per request.

        A whole result goes before an error row; the value breaks ties, so
        every evaluation picks the same row.
        """
        place = F.struct(F.col("error").isNotNull().alias("_failed"), self.name, "error")
        return self.load().groupBy("request_id").agg(F.min(place).alias("_r")).select(
            "request_id", f"_r.{self.name}", "_r.error"
        )

    def fill(self, requests: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Answer the missing requests, append, and return ``results``."""
        answer(self.missing(requests)).select(*self.schema.names).write.mode("append").parquet(self.path)
        return self.results()
