"""The registered queries of the engine's own operators, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _counts_as_bigint(sql: str) -> str:
    """DuckDB's count_if is a HUGEINT."""
    out, at = "", 0
    while (k := sql.find("count_if(", at)) >= 0:
        depth, end = 1, k + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:end] + "::BIGINT"
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if sql:
            _sql[name] = _counts_as_bigint(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql


def oracle_text(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to all cores, before work that is long for a row: a narrow table's file may be a single split."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _load() -> None:
    """Modules register their queries when they are imported."""
    from . import desk_queries, flow_queries, function_queries, log_queries, lookup_queries, rule_queries, source_queries, stream_queries, text_queries  # noqa: F401
