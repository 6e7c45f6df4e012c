"""Chunks for SQL users: a table function that shows the session's tenant its own rows, and nobody any.

``SELECT * FROM visible_chunks()`` reads the stored chunks through session variables. They are part of
the query when it is analysed, so the tenant is a filter of the scan. Without a tenant, or without a
group that may read a chunk, the function returns nothing. Who may set the variables is up to the
server that opens the session; file permissions must keep users off the files themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FUNCTION = "visible_chunks"


def install(spark: SparkSession, path: str, function: str = FUNCTION) -> None:
    """Define the function in this session over the Parquet chunks at ``path`` (with tenant_id, acl_groups, quarantined)."""
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    spark.sql("DECLARE OR REPLACE VARIABLE veil_tenant STRING DEFAULT NULL")
    spark.sql("DECLARE OR REPLACE VARIABLE veil_groups ARRAY<STRING> DEFAULT CAST(array() AS ARRAY<STRING>)")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {function}() RETURNS TABLE ({columns}) RETURN SELECT {names} FROM parquet.`{path}` "
        "WHERE tenant_id = session.veil_tenant AND arrays_overlap(acl_groups, session.veil_groups) AND NOT quarantined"
    )


def act_as(spark: SparkSession, tenant: str | None, groups: Sequence[str] = ()) -> None:
    """The tenant and groups of the queries that follow in this session."""
    spark.sql("SET VARIABLE veil_tenant = CAST(:tenant AS STRING)", args={"tenant": tenant})
    listed = F.array(*[F.lit(g) for g in groups])
    spark.sql("SET VARIABLE veil_groups = CAST(:groups AS ARRAY<STRING>)", args={"groups": listed})
