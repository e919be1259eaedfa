"""The test tables as inputs of the operators: views given by SQL that Spark and DuckDB both read.

``frame`` evaluates such SQL in Spark; oracles put it in front of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of ``sql`` over the tables of ``sf_dir`` that it names."""
    register(spark, sf_dir, [t for t in TABLES if t in sql])
    return spark.sql(sql)


#: A supply graph over whole tables; regions are no nodes, so edges to them dangle.
EDGES = """
SELECT 'C:' || c_custkey AS src, 'N:' || c_nationkey AS dst, 'direct' AS call_type FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'direct' FROM supplier
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'direct' FROM nation
UNION ALL SELECT 'P:' || l_partkey, 'S:' || l_suppkey, CASE WHEN l_quantity >= 49 THEN 'interface' ELSE 'direct' END FROM lineitem
"""
NODES = """
SELECT 'N:' || n_nationkey AS id, 'nation.' || n_name AS name, 'region/' || n_regionkey AS package, 'region/' || n_regionkey || '/nation.go' AS file,
       CAST(n_nationkey AS BIGINT) AS line, 'type' AS kind, '' AS receiver, true AS exported, '' AS signature FROM nation
UNION ALL
SELECT 'C:' || c_custkey, 'customer.' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Test' ELSE 'Get' END || c_custkey, 'internal/customer' || c_nationkey, 'internal/customer' || c_nationkey || '/c.go',
       c_custkey, 'method', CASE WHEN c_acctbal > 5000 THEN 'TxHandler' ELSE lower(c_mktsegment) END, c_acctbal > 0, 'func(id int, name string) (Customer, error)' FROM customer
UNION ALL
SELECT 'S:' || s_suppkey, 'supplier.Deliver' || s_nationkey, 'pkg/supplier' || s_nationkey, 'pkg/supplier' || s_nationkey || '/s.go',
       s_suppkey, 'method', s_name, s_acctbal > 1000, CASE WHEN s_acctbal < 0 THEN 'func(w http.ResponseWriter, r *http.Request)' ELSE 'func(q float64) error' END FROM supplier
UNION ALL
SELECT 'P:' || p_partkey, replace(p_brand, '#', '') || '.' || CASE WHEN p_type = 'SMALL' THEN 'init' ELSE '' END || replace(p_name, ' ', ''), CASE WHEN p_type = 'PROMO' THEN 'cmd/' ELSE 'lib/' END || p_brand, p_brand || '/' || p_name || '.go',
       p_partkey, 'function', '', p_size > 25, 'func(a int, b string)' FROM part
"""
#: Nations that supply another one well above the average pair: a graph with cycles.
TRADE = """
SELECT 'N:' || s_nationkey AS src, 'N:' || c_nationkey AS dst, 'direct' AS call_type
FROM (SELECT s_nationkey, c_nationkey, count(*) AS n, avg(count(*)) OVER () AS mean
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      GROUP BY s_nationkey, c_nationkey) AS pairs
WHERE n > 1.4 * mean
"""
NATIONS = "SELECT 'N:' || n_nationkey AS id, 'region/' || n_regionkey AS package FROM nation"
#: Graphs with cycles that grow with the customers: rings within blocks of 40, some with a way on to the next block.
CUSTOMERS = "SELECT 'C:' || c_custkey AS id, 'block/' || CAST(floor(c_custkey / 40) AS BIGINT) AS package FROM customer"
REFERRALS = """
SELECT 'C:' || c_custkey AS src, 'C:' || (c_custkey - c_custkey % 40 + (c_custkey * 7 + 3) % 40) AS dst, 'direct' AS call_type FROM customer
UNION ALL SELECT 'C:' || c_custkey, 'C:' || (c_custkey - c_custkey % 40 + (c_custkey + 11) % 40), 'direct' FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT 'C:' || c_custkey, 'C:' || (c_custkey + 40), 'direct' FROM customer WHERE c_custkey % 5 = 0 AND floor(c_custkey / 40) % 4 <> 3
"""
