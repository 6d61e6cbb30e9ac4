"""The relational test tables seen as a code graph.

Customers, suppliers, parts and orders are nodes; foreign keys are edges, whose
trust comes from the return flag of the line items behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.store import merge_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, content, file_path, start_line."""

    def rows(name: str, prefix: str, key: str, kind: str, label: Column, content: Column, path: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            _id(prefix, key).alias("id"),
            F.lit(kind).alias("type"),
            label.cast("string").alias("name"),
            content.alias("content"),
            path.alias("file_path"),
            F.col(key).cast("int").alias("start_line"),
        )

    return (
        rows("region", "R", "r_regionkey", "Region", F.col("r_name"), F.lit(""), F.lit("model/regions.cs"))
        .unionByName(rows("nation", "N", "n_nationkey", "Nation", F.col("n_name"), F.lit(""), F.lit("model/nations.cs")))
        .unionByName(
            rows(
                "customer", "C", "c_custkey", "Customer", F.col("c_name"), F.col("c_mktsegment"),
                F.concat(F.lit("src/sales/"), F.lower("c_mktsegment"), F.lit(".cs")),
            )
        )
        .unionByName(rows("supplier", "S", "s_suppkey", "Supplier", F.col("s_name"), F.lit(""), F.lit("src/supply/suppliers.cs")))
        .unionByName(
            rows("part", "P", "p_partkey", "Part", F.col("p_name"), F.col("p_type"), F.concat(F.lit("src/parts/"), F.col("p_brand"), F.lit(".cs")))
        )
        .unionByName(
            rows(
                "orders", "O", "o_orderkey", "Order", F.col("o_orderkey"), F.col("o_orderpriority"),
                F.concat(F.lit("src/orders/"), F.when(F.col("o_orderstatus") == "F", "tests").otherwise(F.lower("o_orderstatus")), F.lit(".cs")),
            )
        )
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relationship, provenance: one row for each of the first three."""

    def rows(df: DataFrame, source: Column, target: Column, relationship: str, provenance: Column) -> DataFrame:
        return df.select(
            source.alias("source"), target.alias("target"), F.lit(relationship).alias("relationship"), provenance.cast("int").alias("provenance")
        )

    nation, orders, lines = (table(spark, sf_dir, t) for t in ("nation", "orders", "lineitem"))
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    fixed = [
        rows(nation, _id("N", "n_nationkey"), _id("R", "n_regionkey"), "BELONGS_TO_MODULE", F.lit(0)),
        rows(customer, _id("N", "c_nationkey"), _id("C", "c_custkey"), "CONTAINS", F.lit(0)),
        rows(supplier, _id("N", "s_nationkey"), _id("S", "s_suppkey"), "CONTAINS", F.lit(0)),
        rows(orders, _id("O", "o_orderkey"), _id("C", "o_custkey"), "REFERENCES_TYPE", F.lit(0)),
        rows(orders, _id("O", "o_orderkey"), F.col("o_orderpriority"), "EXTENDS", F.lit(1)),
    ]
    found = [
        rows(lines, _id("O", "l_orderkey"), _id("P", "l_partkey"), "CALLS", flag),
        rows(lines, _id("P", "l_partkey"), _id("S", "l_suppkey"), "REFERENCES_TYPE", flag),
    ]
    out = fixed[0]
    for f in fixed[1:]:
        out = out.unionByName(f)
    return out.unionByName(merge_edges(found[0].unionByName(found[1])))


#: The same two tables for DuckDB, as common table expressions.
CTES = """
nodes AS (
  SELECT 'R:' || r_regionkey AS id, 'Region' AS type, r_name AS name, '' AS content, 'model/regions.cs' AS file_path, CAST(r_regionkey AS INTEGER) AS start_line FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'Nation', n_name, '', 'model/nations.cs', CAST(n_nationkey AS INTEGER) FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'Customer', c_name, c_mktsegment, 'src/sales/' || lower(c_mktsegment) || '.cs', CAST(c_custkey AS INTEGER) FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'Supplier', s_name, '', 'src/supply/suppliers.cs', CAST(s_suppkey AS INTEGER) FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, 'Part', p_name, p_type, 'src/parts/' || p_brand || '.cs', CAST(p_partkey AS INTEGER) FROM part
  UNION ALL SELECT 'O:' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR), o_orderpriority,
    'src/orders/' || CASE WHEN o_orderstatus = 'F' THEN 'tests' ELSE lower(o_orderstatus) END || '.cs', CAST(o_orderkey AS INTEGER) FROM orders
),
edges AS (
  SELECT 'N:' || n_nationkey AS source, 'R:' || n_regionkey AS target, 'BELONGS_TO_MODULE' AS relationship, 0 AS provenance FROM nation
  UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, 'CONTAINS', 0 FROM customer
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'CONTAINS', 0 FROM supplier
  UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey, 'REFERENCES_TYPE', 0 FROM orders
  UNION ALL SELECT 'O:' || o_orderkey, o_orderpriority, 'EXTENDS', 1 FROM orders
  UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'CALLS', min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'P:' || l_partkey, 'S:' || l_suppkey, 'REFERENCES_TYPE', min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) FROM lineitem GROUP BY 1, 2
)
"""


def oracle(sql: str) -> str:
    """``sql`` (which may begin with further expressions, then a SELECT) over the graph."""
    return f"WITH RECURSIVE {CTES}{sql}"
