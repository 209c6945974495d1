"""Graphs and tables of this engine's kinds, derived from the driver's business tables.

Each has the same derivation in SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _edge(source: Column, target: Column, kind: str, key: str) -> list[Column]:
    return [source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), (F.col(key) % 10 / F.lit(10.0)).alias("confidence_score")]


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> customer and supplier, customer -> order, order -> part."""
    c, s, o, l = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    return (
        c.select(*_edge(_id("nation", "c_nationkey"), _id("customer", "c_custkey"), "holds", "c_custkey"))
        .unionByName(s.select(*_edge(_id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "holds", "s_suppkey")))
        .unionByName(o.select(*_edge(_id("customer", "o_custkey"), _id("order", "o_orderkey"), "read", "o_orderkey")))
        .unionByName(l.select("l_orderkey", "l_partkey").distinct().select(*_edge(_id("order", "l_orderkey"), _id("part", "l_partkey"), "write", "l_partkey")))
    )


def transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(_id("order", "o_orderkey").alias("identity"))


def data_nodes(spark: SparkSession, sf_dir: str, thinned: bool = False) -> DataFrame:
    """All nodes but orders.  Thinned: without every 97th, whose edges then lead nowhere known."""
    out = None
    for name, kind, key in (("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey")):
        rows = table(spark, sf_dir, name)
        if thinned:
            rows = rows.where(F.col(key) % 97 != 0)
        rows = rows.select(_id(kind, key).alias("identity"), F.lit(kind).alias("namespace"))
        out = rows if out is None else out.unionByName(rows)
    return out


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer and supplier."""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    pair = lambda df, a, x, b, y: df.select(_id(a, x).alias("source"), _id(b, y).alias("target"))
    return pair(n, "region", "n_regionkey", "nation", "n_nationkey").union(pair(c, "nation", "c_nationkey", "customer", "c_custkey")).union(pair(s, "nation", "s_nationkey", "supplier", "s_suppkey"))


def geo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and suppliers; suppliers are informational."""
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        rows = table(spark, sf_dir, name).select(_id(name, key).alias("identity"), F.lit(name == "supplier").alias("is_informational"))
        out = rows if out is None else out.unionByName(rows)
    return out


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types in order: type -> next type."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    return rows.where("target is not null").distinct()


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits: author the user, path the type and a tenth of the users, lines the value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("sha"),
        F.col("user_id").cast("string").alias("author"),
        F.col("ts"),
        F.concat("event_type", F.lit("/"), (F.col("user_id") % 10).cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("event_id") % 50 != 0, F.floor(F.col("value") % 7).cast("int")).alias("added"),
        F.when(F.col("event_id") % 50 != 0, (F.col("event_id") % 3).cast("int")).alias("deleted"),
    )


def names_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw dataset names with their namespaces, of many shapes."""
    p = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 4 == 0, "S3A").when(F.col("p_size") % 4 == 1, "pg").when(F.col("p_size") % 4 == 2, "unknown").otherwise("dbt").alias("ns"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("s3://Lake/raw_"), "p_brand", F.lit("/dt=2024-01-"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_size").cast("string"), F.lit(".parquet")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("DB.Sch.T"), F.col("p_size").cast("string")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("__dbt_source_raw_order_"), F.col("p_size").cast("string"), F.lit("__")))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit('"dev_'), F.col("p_size").cast("string"), F.lit('.csv"')))
        .otherwise(F.concat(F.lit("__dbt_ref_stg_"), F.col("p_size").cast("string"), F.lit("__")))
        .alias("raw"),
    )
    return p.distinct()


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a made-up repository: folders and extensions by page number."""
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("page_id") % len(FOLDERS) + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("page_id") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.concat(folder, F.lit("m"), F.col("page_id").cast("string"), ext).alias("identity"))


FOLDERS = ("src/agents/", "src/utils/", "models/marts/", "models/staging/", "tests/", "seeds/", "data/", "src/graph/", "lib/analyzers/", "", "src/", "app/models/")
EXTENSIONS = (".py", ".sql", ".yml", ".md", ".toml", ".csv", ".txt")

_in = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

SQL = {
    "edges": """edges as (
  select 'nation:' || c_nationkey as source, 'customer:' || c_custkey as target, 'holds' as type, cast(c_custkey % 10 as double) / 10.0 as confidence_score from customer
  union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'holds', cast(s_suppkey % 10 as double) / 10.0 from supplier
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'read', cast(o_orderkey % 10 as double) / 10.0 from orders
  union all select distinct 'order:' || l_orderkey, 'part:' || l_partkey, 'write', cast(l_partkey % 10 as double) / 10.0 from lineitem)""",
    "trans": "trans as (select 'order:' || o_orderkey as identity from orders)",
    "data": """data as (
  select 'nation:' || n_nationkey as identity, 'nation' as namespace from nation union all select 'customer:' || c_custkey, 'customer' from customer
  union all select 'supplier:' || s_suppkey, 'supplier' from supplier union all select 'part:' || p_partkey, 'part' from part)""",
    "thin": """thin as (
  select 'nation:' || n_nationkey as identity from nation where n_nationkey % 97 <> 0 union all select 'customer:' || c_custkey from customer where c_custkey % 97 <> 0
  union all select 'supplier:' || s_suppkey from supplier where s_suppkey % 97 <> 0 union all select 'part:' || p_partkey from part where p_partkey % 97 <> 0)""",
    "geo": """geo as (
  select 'region:' || n_regionkey as source, 'nation:' || n_nationkey as target from nation
  union all select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer
  union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey from supplier)""",
    "geonodes": """geonodes as (
  select 'region:' || r_regionkey as identity, false as is_informational from region union all select 'nation:' || n_nationkey, false from nation
  union all select 'customer:' || c_custkey, false from customer union all select 'supplier:' || s_suppkey, true from supplier)""",
    "evt": """evt as (
  select distinct source, target from (
    select event_type as source, lead(event_type) over (partition by user_id order by ts, event_id) as target from events) where target is not null)""",
    "commits": """commits as (
  select cast(event_id as varchar) as sha, cast(user_id as varchar) as author, ts, event_type || '/' || (user_id % 10) || '.py' as path,
    case when event_id % 50 <> 0 then cast(floor(value % 7) as int) end as added, case when event_id % 50 <> 0 then cast(event_id % 3 as int) end as deleted from events)""",
    "raws": """raws as (
  select distinct case p_size % 4 when 0 then 'S3A' when 1 then 'pg' when 2 then 'unknown' else 'dbt' end as ns,
    case p_partkey % 5 when 0 then 's3://Lake/raw_' || p_brand || '/dt=2024-01-' || p_size || '/' || p_size || '.parquet'
      when 1 then 'DB.Sch.T' || p_size when 2 then '__dbt_source_raw_order_' || p_size || '__' when 3 then '"dev_' || p_size || '.csv"'
      else '__dbt_ref_stg_' || p_size || '__' end as raw from part)""",
    "paths": f"""paths as (
  select ({_in(FOLDERS)})[page_id % {len(FOLDERS)} + 1] || 'm' || page_id || ({_in(EXTENSIONS)})[page_id % {len(EXTENSIONS)} + 1] as identity from pages)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
