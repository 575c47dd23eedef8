"""The log frames in DuckDB SQL, as a preamble that the oracle queries share."""

PREAMBLE = """
WITH line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey
    ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem),
ship AS (SELECT *, 'sh-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || rn AS ev_id FROM line),
event AS (
  SELECT 'po-' || o_orderkey AS ev_id, 'place order' AS ev_type, o_orderdate AS ev_time FROM orders
  UNION ALL SELECT ev_id, 'ship item', l_shipdate FROM ship
  UNION ALL SELECT 'ev-' || event_id, event_type, ts FROM events),
object AS (
  SELECT 'c-' || c_custkey AS ob_id, 'customer' AS ob_type FROM customer UNION ALL SELECT 'o-' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT 'p-' || p_partkey, 'part' FROM part UNION ALL SELECT 's-' || s_suppkey, 'supplier' FROM supplier
  UNION ALL SELECT 'n-' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'r-' || r_regionkey, 'region' FROM region),
o2o AS (
  SELECT 'o-' || o_orderkey AS src_id, 'order' AS src_type, 'c-' || o_custkey AS dst_id, 'customer' AS dst_type, 'placed by' AS qualifier FROM orders
  UNION ALL SELECT 'c-' || c_custkey, 'customer', 'n-' || c_nationkey, 'nation', 'located in' FROM customer
  UNION ALL SELECT 's-' || s_suppkey, 'supplier', 'n-' || s_nationkey, 'nation', 'located in' FROM supplier
  UNION ALL SELECT 'n-' || n_nationkey, 'nation', 'r-' || n_regionkey, 'region', 'part of' FROM nation),
e2o AS (
  SELECT 'po-' || o_orderkey AS ev_id, 'place order' AS ev_type, o_orderdate AS ev_time, 'o-' || o_orderkey AS ob_id, 'order' AS ob_type, 'order' AS qualifier FROM orders
  UNION ALL SELECT 'po-' || o_orderkey, 'place order', o_orderdate, 'c-' || o_custkey, 'customer', 'customer' FROM orders
  UNION ALL SELECT ev_id, 'ship item', l_shipdate, 'o-' || l_orderkey, 'order', 'order' FROM ship
  UNION ALL SELECT ev_id, 'ship item', l_shipdate, 'p-' || l_partkey, 'part', 'part' FROM ship
  UNION ALL SELECT ev_id, 'ship item', l_shipdate, 's-' || l_suppkey, 'supplier', 'supplier' FROM ship
  UNION ALL SELECT 'ev-' || event_id, event_type, ts, 'c-' || user_id, 'customer', 'actor' FROM events),
event_num AS (
  SELECT 'po-' || o_orderkey AS ev_id, 'totalprice' AS name, o_totalprice AS v FROM orders
  UNION ALL SELECT ev_id, 'quantity', l_quantity FROM ship UNION ALL SELECT ev_id, 'extendedprice', l_extendedprice FROM ship
  UNION ALL SELECT 'ev-' || event_id, 'value', value FROM events
  UNION ALL SELECT 'ev-' || event_id, 'k', TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events),
event_str AS (
  SELECT 'po-' || o_orderkey AS ev_id, 'priority' AS name, o_orderpriority AS v FROM orders UNION ALL SELECT ev_id, 'returnflag', l_returnflag FROM ship),
flag AS (
  SELECT 'o-' || l_orderkey AS ob_id, l_shipdate AS ts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, rn) AS ordinal, l_returnflag AS v FROM ship),
object_num AS (
  SELECT 'c-' || c_custkey AS ob_id, 'acctbal' AS name, c_acctbal AS v FROM customer UNION ALL SELECT 's-' || s_suppkey, 'acctbal', s_acctbal FROM supplier
  UNION ALL SELECT 'p-' || p_partkey, 'size', p_size FROM part UNION ALL SELECT 'p-' || p_partkey, 'retailprice', p_retailprice FROM part),
object_str AS (
  SELECT 'c-' || c_custkey AS ob_id, 'mktsegment' AS name, c_mktsegment AS v FROM customer UNION ALL SELECT 'o-' || o_orderkey, 'status', o_orderstatus FROM orders
  UNION ALL SELECT 'p-' || p_partkey, 'brand', p_brand FROM part)
"""


def sql(body: str, ctes: str = "") -> str:
    """The preamble, more CTEs and a SELECT."""
    return PREAMBLE.strip() + (",\n" + ctes.strip() if ctes else "") + "\n" + body.strip()
