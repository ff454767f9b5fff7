"""A graph derived from the order tables: nations, regions, suppliers, customers, part types and brands.

The SQL reads the same in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.graph import Graph
from weftgraph.stage import table

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

VERTICES_SQL = """
select n_name as id, 'country' as grp, cast((n_nationkey * 37) % 51 + 50 as double) / 100 as confidence from {nation}
union all select r_name, 'organization', cast((r_regionkey * 37) % 51 + 50 as double) / 100 from {region}
union all select s_name, 'organization', cast((s_suppkey * 37) % 51 + 50 as double) / 100 from {supplier}
union all select distinct p_type, 'resource', cast(1.0 as double) from {part}
union all select distinct p_brand, 'technology', cast(1.0 as double) from {part}
union all select c_name, 'person', cast((c_custkey * 37) % 51 + 50 as double) / 100 from {customer}
"""
EDGES_SQL = """
with flow as (
  select cn.n_name as src, sn.n_name as dst, o.o_orderpriority as pri, sum(l.l_quantity) as qty
  from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey
  join {customer} c on o.o_custkey = c.c_custkey join {nation} cn on c.c_nationkey = cn.n_nationkey
  join {supplier} s on l.l_suppkey = s.s_suppkey join {nation} sn on s.s_nationkey = sn.n_nationkey
  group by cn.n_name, sn.n_name, o.o_orderpriority),
best as (select src, dst, pri, qty, row_number() over (partition by src, dst order by qty desc, pri) as rk from flow),
pair as (select src, dst, pri, qty, row_number() over (partition by src order by qty desc, dst) as rn from best where rk = 1 and src <> dst),
trade as (select src, dst, case substr(pri, 1, 1) when '1' then 'imposes sanctions on' when '2' then 'threatens'
    when '3' then 'signs trade treaty with' when '4' then 'monitors' else 'cooperates with' end as label,
  cast(0.5 as double) + cast(cast(qty as bigint) % 50 as double) / 100 as confidence from pair where rn <= 6)
select * from trade
union all select s_name, n_name, 'based in', cast(1.0 as double) from {supplier} join {nation} on s_nationkey = n_nationkey
union all select n_name, r_name, 'member of', cast(1.0 as double) from {nation} join {region} on n_regionkey = r_regionkey
"""
_named = {t: t for t in TABLES}
#: Common table expressions v and e for DuckDB.
CTES = f"v as ({VERTICES_SQL.format(**_named)}), e as ({EDGES_SQL.format(**_named)})"


def sql(spark: SparkSession, sf_dir: str, query: str, **frames: DataFrame) -> DataFrame:
    """A query over the order tables, named in braces."""
    used = {t: table(spark, sf_dir, t) for t in (*TABLES, "events", "documents", "pages") if "{" + t + "}" in query}
    return spark.sql(query, **used, **frames)


def build(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(sql(spark, sf_dir, VERTICES_SQL).withColumnRenamed("grp", "group"), sql(spark, sf_dir, EDGES_SQL))
