"""Query sources: option builders plus one reader per connector family."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Driver class and URL pattern per dialect.
DIALECTS = {
    "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "postgresql": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "sqlserver": (
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={database}",
        1433,
    ),
    "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{database}", 0),
    "snowflake": (
        "net.snowflake.client.jdbc.SnowflakeDriver",
        "jdbc:snowflake://{host}/?db={database}",
        443,
    ),
}
SQLITE_TABLES = "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name"


def limited(sql: str, limit: int | None) -> str:
    """The query with a LIMIT, unless it has one."""
    sql = sql.strip().rstrip(";")
    if limit is None or re.search(r"\blimit\s+\d+", sql, re.IGNORECASE):
        return sql
    return f"{sql} LIMIT {limit}"


def jdbc_options(
    dialect: str, sql: str, database: str, host: str = "localhost", port: int | None = None,
    user: str | None = None, password: str | None = None, limit: int | None = None,
    partition_column: str | None = None, lower: object = None, upper: object = None,
    partitions: int = 1, fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the read is split over `partitions` tasks."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect}")
    driver, url, default_port = DIALECTS[dialect]
    options = {
        "url": url.format(host=host, port=port or default_port, database=database),
        "driver": driver,
        "fetchsize": str(fetch_size),
    }
    if dialect == "sqlserver" and limit is not None:
        sql = re.sub(r"(?i)^\s*select\s+(?!top\b)", f"SELECT TOP {limit} ", sql.strip().rstrip(";"), count=1)
    else:
        sql = limited(sql, limit)
    if partition_column:
        # `query` and `partitionColumn` exclude each other.
        options.update(
            dbtable=f"({sql}) t", partitionColumn=partition_column, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions),
        )
    else:
        options["query"] = sql
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    return options


def read_jdbc(spark: SparkSession, dialect: str, sql: str, database: str, **settings) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(dialect, sql, database, **settings)).load()


def sqlite_tables(spark: SparkSession, database: str) -> DataFrame:
    return read_jdbc(spark, "sqlite", SQLITE_TABLES, database)


def bigquery_options(sql: str, project: str, credentials_file: str | None = None, dataset: str | None = None) -> dict:
    options = {"query": sql, "parentProject": project, "viewsEnabled": "true"}
    if credentials_file:
        options["credentialsFile"] = credentials_file
    if dataset:
        options["materializationDataset"] = dataset
    return options


def read_bigquery(spark: SparkSession, sql: str, project: str, **settings) -> DataFrame:
    return spark.read.format("bigquery").options(**bigquery_options(sql, project, **settings)).load()


def mongodb_options(uri: str, database: str, collection: str, match: str | None = None) -> dict[str, str]:
    options = {"connection.uri": uri, "database": database, "collection": collection}
    if match:
        options["aggregation.pipeline"] = f'[{{"$match": {match}}}]'
    return options


def read_mongodb(
    spark: SparkSession, uri: str, database: str, collection: str, match: str | None = None,
    skip: int = 0, limit: int | None = None,
) -> DataFrame:
    df = spark.read.format("mongodb").options(**mongodb_options(uri, database, collection, match)).load()
    df = df.drop("_id")
    if skip:
        df = df.offset(skip)
    return df if limit is None else df.limit(limit)
