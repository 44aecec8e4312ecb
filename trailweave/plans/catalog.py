"""The query catalogue over the driver's tables: graph queries, each with the SQL that gives
the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import access
from trailweave.session import query
from trailweave.sources.testdata import load, node_id

#: name -> (query, parameters, SQL)
GRAPH: dict[str, tuple[str, dict | None, str]] = {
    "node_scan": ("MATCH (c:Customer) RETURN c.custkey AS k, c.name AS name", None, "SELECT c_custkey AS k, c_name AS name FROM customer"),
    "node_scan_all_labels": (
        "MATCH (x) WHERE x.nationkey < 3 RETURN x.name AS name, x.acctbal AS bal",
        None,
        "SELECT n_name AS name, NULL::DOUBLE AS bal FROM nation WHERE n_nationkey < 3 UNION ALL SELECT c_name, c_acctbal FROM customer WHERE c_nationkey < 3 UNION ALL SELECT s_name, s_acctbal FROM supplier WHERE s_nationkey < 3",
    ),
    "filter_bool": ("MATCH (c:Customer) WHERE c.acctbal > 5000 AND NOT c.mktsegment = 'BUILDING' RETURN c.custkey AS k", None, "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'"),
    "filter_or": ("MATCH (p:Part) WHERE p.size = 1 OR p.size >= 49 RETURN p.partkey AS k, p.size AS size", None, "SELECT p_partkey AS k, p_size::BIGINT AS size FROM part WHERE p_size = 1 OR p_size >= 49"),
    "filter_truthy": ("MATCH (n:Nation) WHERE n.regionkey RETURN n.name AS name", None, "SELECT n_name AS name FROM nation WHERE n_regionkey <> 0"),
    "prop_predicate": ("MATCH (p:Part {size: 11}) RETURN p.partkey AS k, p.brand AS brand", None, "SELECT p_partkey AS k, p_brand AS brand FROM part WHERE p_size = 11"),
    "step_right": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WHERE c.acctbal > 5000 RETURN c.name AS cname, n.name AS nname", None, "SELECT c_name AS cname, n_name AS nname FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000"),
    "step_left": ("MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE o.totalprice > 300000 RETURN o.orderkey AS o, c.name AS name", None, "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "step_any": ("MATCH (n:Nation)-[:IN_REGION]-(m) RETURN n.name AS name, COUNT(*) AS c", None, "SELECT n_name AS name, count(*) AS c FROM nation GROUP BY n_name"),
    "step_left_or_right": (
        "MATCH (a)<-[:IN_REGION]->(b) RETURN a.name AS a, b.name AS b",
        None,
        "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "step_undirected": ("MATCH (a:Nation)~[:NEIGHBOR]~(b) RETURN a.name AS a, b.name AS b", None, "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"),
    "step_left_or_undirected": ("MATCH (a:Nation)<~[:NEIGHBOR]~(b) RETURN a.nationkey AS a, COUNT(*) AS n", None, "SELECT a.n_nationkey::BIGINT AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY ALL"),
    "step_right_or_undirected": ("MATCH (a:Region)~[:IN_REGION]~>(b) RETURN COUNT(*) AS n", None, "SELECT 0::BIGINT AS n"),
    "multi_hop": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN r.name AS region, n.name AS nation, c.custkey AS c, o.orderkey AS o",
        None,
        "SELECT r_name AS region, n_name AS nation, c_custkey AS c, o_orderkey AS o FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    ),
    "edge_props": (
        "MATCH (o:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE l.quantity > 45 RETURN o.orderkey AS o, p.partkey AS p, l.quantity AS qty",
        None,
        "SELECT l_orderkey AS o, l_partkey AS p, l_quantity AS qty FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45",
    ),
    "step_between": (
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part {size: 7}), (s)-[:BASED_IN]->(n:Nation), (o:Order)-[:CONTAINS]->(p), (s)-[:SUPPLIES]->(p) WHERE o.totalprice > 300000 RETURN s.suppkey AS s, p.partkey AS p, n.name AS n, o.orderkey AS o",
        None,
        "SELECT DISTINCT ON (l.l_orderkey, l.l_partkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate, s_suppkey) s_suppkey AS s, p_partkey AS p, n_name AS n, o_orderkey AS o FROM part JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) e ON e.pk = p_partkey JOIN supplier ON s_suppkey = e.sk JOIN nation ON s_nationkey = n_nationkey JOIN lineitem l ON l.l_partkey = p_partkey JOIN orders ON o_orderkey = l.l_orderkey WHERE p_size = 7 AND o_totalprice > 300000",
    ),
    "repeated_variable": (
        "MATCH (a:Nation)~[:NEIGHBOR]~(b)~[:NEIGHBOR]~(c)~[:NEIGHBOR]~(a) RETURN a.name AS a, COUNT(*) AS triangles",
        None,
        "SELECT a.n_name AS a, count(*) AS triangles FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN nation c ON c.n_regionkey = a.n_regionkey AND c.n_nationkey <> b.n_nationkey AND c.n_nationkey <> a.n_nationkey GROUP BY ALL",
    ),
    "edge_reuse": (
        "MATCH (c:Customer)-[e:PLACED]->(o:Order), (x)-[e:PLACED]->(y) WHERE o.totalprice > 350000 RETURN c.custkey AS c, o.orderkey AS o",
        None,
        "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_totalprice > 350000",
    ),
    "cross_join": ("MATCH (r:Region), (n:Nation) RETURN r.name AS r, n.name AS n", None, "SELECT r_name AS r, n_name AS n FROM region, nation"),
    "correlated_join": ("MATCH (n:Nation), (m:Nation {regionkey: n.regionkey}) RETURN n.name AS n, m.name AS m", None, "SELECT n.n_name AS n, m.n_name AS m FROM nation n JOIN nation m ON n.n_regionkey = m.n_regionkey"),
    "label_filter": (
        "MATCH (n:Nation)-[:IN_REGION]-(m:Region) RETURN n.name AS n, m.name AS m",
        None,
        "SELECT n_name AS n, r_name AS m FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "label_filter_any_edge": (
        "MATCH (n:Nation {nationkey: 3})<-[]-(x:Customer) RETURN x.custkey AS k",
        None,
        "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3",
    ),
    "semi_join": ("MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status: 'F'}) RETURN c.custkey AS k", None, "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "anti_join": ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {status: 'F'}) RETURN c.custkey AS k, c.name AS name", None, "SELECT c_custkey AS k, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "optional": ("MATCH (d:Document) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l) RETURN d.doc_id AS doc_id, l.quality AS quality", None, "SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "optional_where": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l) WHERE l.quality = 0 RETURN d.doc_id AS doc_id, l.toxic AS toxic",
        None,
        "SELECT d.doc_id, l.toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 0",
    ),
    "optional_first": ("OPTIONAL MATCH (n:Nation {name: 'NOWHERE'}) RETURN n.name AS name, 1 AS one", None, "SELECT NULL::VARCHAR AS name, 1::BIGINT AS one"),
    "agg_global": (
        "MATCH (p:Part) RETURN COUNT(*) AS n, COUNT(p.size) AS c, SUM(p.size) AS s, AVG(p.size) AS a, MIN(p.size) AS lo, MAX(p.name) AS hi",
        None,
        "SELECT count(*) AS n, count(p_size) AS c, sum(p_size)::BIGINT AS s, avg(p_size) AS a, min(p_size)::BIGINT AS lo, max(p_name) AS hi FROM part",
    ),
    "agg_group": ("MATCH (p:Part) RETURN p.brand AS brand, COUNT(*) AS n, SUM(p.size) AS s, MIN(p.retailprice) AS lo", None, "SELECT p_brand AS brand, count(*) AS n, sum(p_size)::BIGINT AS s, min(p_retailprice) AS lo FROM part GROUP BY p_brand"),
    "agg_distinct": (
        "MATCH (p:Part) RETURN p.brand AS brand, COUNT(DISTINCT p.size) AS n, SUM(DISTINCT p.size) AS s, AVG(DISTINCT p.size) AS a",
        None,
        "SELECT p_brand AS brand, count(DISTINCT p_size) AS n, sum(DISTINCT p_size)::BIGINT AS s, sum(DISTINCT p_size)::DOUBLE / count(DISTINCT p_size) AS a FROM part GROUP BY p_brand",
    ),
    "agg_expr": ("MATCH (c:Customer) RETURN c.mktsegment AS seg, COUNT(*) * 2 + 1 AS n, MAX(c.custkey) - MIN(c.custkey) AS span", None, "SELECT c_mktsegment AS seg, count(*) * 2 + 1 AS n, max(c_custkey) - min(c_custkey) AS span FROM customer GROUP BY 1"),
    "agg_empty": ("MATCH (p:Part {size: 9999}) RETURN COUNT(*) AS n, SUM(p.size) AS s, MAX(p.name) AS m", None, "SELECT 0::BIGINT AS n, NULL::BIGINT AS s, NULL::VARCHAR AS m"),
    "agg_empty_group": ("MATCH (p:Part {size: 9999}) RETURN 1 AS k, COUNT(*) AS n", None, "SELECT 1::BIGINT AS k, 0::BIGINT AS n WHERE false"),
    "with_agg": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'F'}) WITH c, COUNT(o) AS n RETURN n, COUNT(*) AS customers",
        None,
        "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey) GROUP BY n",
    ),
    "distinct": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN DISTINCT c.mktsegment AS seg, o.status AS status", None, "SELECT DISTINCT c_mktsegment AS seg, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey"),
    "order_top": ("MATCH (o:Order) RETURN o.orderkey AS o, o.totalprice AS p ORDER BY p DESC, o LIMIT 25", None, "SELECT o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY p DESC, o LIMIT 25"),
    "order_hidden": ("MATCH (c:Customer) RETURN c.name AS name ORDER BY c.acctbal, c.custkey LIMIT 10", None, "SELECT c_name AS name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10"),
    "sort": ("MATCH (c:Customer) RETURN c.custkey AS k, c.acctbal AS bal ORDER BY bal DESC, k", None, "SELECT c_custkey AS k, c_acctbal AS bal FROM customer ORDER BY bal DESC, k"),
    "truthy_kinds": (
        "MATCH (n:Nation) RETURN n.name AS name, NOT n.name AS s, NOT n.nationkey * 1.0 AS f, NOT (n.nationkey - 3) AS i, NOT null AS z, NOT '' AS e, NOT $list AS l",
        {"list": [1]},
        "SELECT n_name AS name, false AS s, n_nationkey = 0 AS f, n_nationkey = 3 AS i, true AS z, true AS e, false AS l FROM nation",
    ),
    "skip_limit": ("MATCH (c:Customer) RETURN c.custkey AS k ORDER BY k SKIP 20 LIMIT 15", None, "SELECT c_custkey AS k FROM customer ORDER BY k LIMIT 15 OFFSET 20"),
    "limit_zero": ("MATCH (n:Nation) RETURN n.name AS name LIMIT 0", None, "SELECT n_name AS name FROM nation LIMIT 0"),
    "nulls_last": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l) RETURN d.doc_id AS doc_id, l.quality AS quality ORDER BY quality DESC, doc_id LIMIT 40",
        None,
        "SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY quality DESC NULLS FIRST, doc_id LIMIT 40",
    ),
    "null_equals_null": (
        "OPTIONAL MATCH (d:Document)-[:HAS_LABEL]->(l) WITH d, l.quality AS q MATCH (d) WHERE NOT q = null RETURN COUNT(*) AS n",
        None,
        "SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    ),
    "null_eq": (
        "MATCH (d:Document) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l) WITH d, l.quality AS q MATCH (d) WHERE q = null RETURN d.doc_id AS doc_id",
        None,
        "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    ),
    "union_all": ("MATCH (c:Customer) RETURN c.nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.nationkey AS k", None, "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey::BIGINT FROM supplier"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k", None, "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier"),
    "union_mixed": (
        "MATCH (r:Region) RETURN r.name AS x UNION MATCH (r:Region) RETURN r.name AS x UNION ALL MATCH (n:Nation) RETURN n.name AS x",
        None,
        "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation",
    ),
    "repeat_walk": (
        "MATCH (a:Turn)-[:NEXT]->{1,3}(b) RETURN a.conv_id AS c, a.turn AS s, b.turn AS t",
        None,
        "SELECT a.conv_id AS c, a.turn AS s, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 3",
    ),
    "repeat_trail": ("MATCH TRAIL (a:Nation)~[:NEIGHBOR]~{2,2}(b) RETURN COUNT(*) AS n", None, "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN nation c ON c.n_regionkey = b.n_regionkey AND c.n_nationkey NOT IN (a.n_nationkey, b.n_nationkey)"),
    "repeat_zero": (
        "MATCH (a:Turn {turn: 0})-[:NEXT]->{0,2}(b) RETURN a.conv_id AS c, b.turn AS t",
        None,
        "SELECT conv_id AS c, turn AS t FROM conversations WHERE turn <= 2",
    ),
    "repeat_bound": (
        "MATCH (a:Nation), (b:Nation {name: 'NATION_3'}) MATCH (a)~[:NEIGHBOR]~{1,2}(b) RETURN a.name AS a, COUNT(*) AS n",
        None,
        "WITH e AS (SELECT a.n_nationkey AS u, b.n_nationkey AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), w AS (SELECT u, v FROM e UNION ALL SELECT x.u, y.v FROM e x JOIN e y ON x.v = y.u) SELECT a.n_name AS a, count(*) AS n FROM w JOIN nation a ON a.n_nationkey = u JOIN nation b ON b.n_nationkey = v WHERE b.n_name = 'NATION_3' GROUP BY 1",
    ),
    "repeat_collect_index": (
        "MATCH TRAIL (a:Turn)-[e:NEXT]->{2,2}(b) WITH a, b, e[1] AS f RETURN a.turn AS t, f.turn AS mid",
        None,
        "SELECT a.turn AS t, a.turn + 1 AS mid FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2",
    ),
    "repeat_edge_filter": (
        "MATCH (a:Turn)-[:NEXT {turn: 1}]->{1,2}(b) RETURN a.conv_id AS c, b.turn AS t",
        None,
        "SELECT a.conv_id AS c, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 1 AND b.turn = 2",
    ),
    "params": ("MATCH (c:Customer {mktsegment: $seg}) WHERE c.acctbal > $least RETURN c.custkey AS k, $seg AS seg", {"seg": "BUILDING", "least": 9000}, "SELECT c_custkey AS k, 'BUILDING' AS seg FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000"),
    "param_list_index": ("MATCH (n:Nation {nationkey: $keys[1]}) RETURN n.name AS name, $keys[9] AS none", {"keys": [3, 5]}, "SELECT n_name AS name, NULL::BIGINT AS none FROM nation WHERE n_nationkey = 5"),
    "arithmetic": ("MATCH (p:Part) RETURN p.partkey * 2 + p.size - 1 AS x, 1 + 2 * 3 AS seven", None, "SELECT p_partkey * 2 + p_size - 1 AS x, 7::BIGINT AS seven FROM part"),
    "concat": ("MATCH (p:Part) RETURN p.brand + '/' + p.name AS s, p.brand + 1 = null AS bad", None, "SELECT p_brand || '/' || p_name AS s, true AS bad FROM part"),
    "compare_mixed": ("MATCH (n:Nation) RETURN n.name AS name, n.name = 3 AS eq, n.name <> 3 AS ne, n.name < 3 AS lt, n.nationkey = 3.0 AS num", None, "SELECT n_name AS name, false AS eq, true AS ne, false AS lt, n_nationkey = 3 AS num FROM nation"),
    "with_scope": ("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) WITH n.name AS nation, c.acctbal AS bal RETURN nation, COUNT(bal) AS n, MAX(bal) AS best", None, "SELECT n_name AS nation, count(c_acctbal) AS n, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "anonymous_nodes": ("MATCH -[:IN_REGION]->(r:Region) RETURN r.name AS r, COUNT(*) AS n", None, "SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "literal": ("RETURN 100 * 3 AS x, 'a' + \"b\" AS s, TRUE AS t, NULL AS n", None, "SELECT 300::BIGINT AS x, 'ab' AS s, true AS t, NULL::BIGINT AS n"),
    "flagship": (
        """MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order)
        WHERE o.totalprice > 200000
        OPTIONAL MATCH (o)-[l:CONTAINS]->(p:Part) WHERE l.returnflag = 'R'
        WITH n, c, COUNT(p) AS returned
        RETURN n.name AS nation, COUNT(*) AS customers, SUM(returned) AS returned_parts
        ORDER BY returned_parts DESC, nation LIMIT 10""",
        None,
        """WITH m AS (SELECT n.n_nationkey, n.n_name, c.c_custkey, o.o_orderkey
          FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
          JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
          WHERE o.o_totalprice > 200000),
        g AS (SELECT n_nationkey, any_value(n_name) AS nation, c_custkey, count(l.l_orderkey) AS returned
          FROM m LEFT JOIN lineitem l ON l.l_orderkey = m.o_orderkey AND l.l_returnflag = 'R'
          GROUP BY n_nationkey, c_custkey)
        SELECT nation, count(*) AS customers, sum(returned)::BIGINT AS returned_parts
        FROM g GROUP BY nation ORDER BY returned_parts DESC, nation LIMIT 10""",
    ),
}


def _graph_query(text: str, params: dict | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(load(spark, sf_dir), text, params)


def _node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load(spark, sf_dir)
    wanted = graph.nodes("Order", {"totalprice"}).where("totalprice > 300000").select("id")
    return access.node_by_id(graph, wanted, label="Order").select(F.col("orderkey").alias("o"), F.col("status"))


def _edge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load(spark, sf_dir)
    wanted = graph.nodes("Customer", {"custkey", "acctbal"}).where("acctbal > 0").select(F.concat(F.lit("LIVES_IN:"), "custkey").alias("eid"))
    found = access.edge_by_id(graph, wanted, label="LIVES_IN")
    return found.select((F.col("src") - node_id("Customer", F.lit(0))).alias("c"), (F.col("dst") - node_id("Nation", F.lit(0))).alias("n"))


def _edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = access.edge_scan(load(spark, sf_dir), "PLACED", set())
    return found.select((F.col("src") - node_id("Customer", F.lit(0))).alias("c"), (F.col("dst") - node_id("Order", F.lit(0))).alias("o"))


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load(spark, sf_dir)
    ends = access.project_endpoints(graph, access.edge_scan(graph, "BASED_IN", set()).select("eid"), label="BASED_IN")
    return ends.select((F.col("start") - node_id("Supplier", F.lit(0))).alias("s"), (F.col("end") - node_id("Nation", F.lit(0))).alias("n"))


def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.empty_result(load(spark, sf_dir).nodes("Nation", {"name"}).select("name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _graph_query(text, params) for name, (text, params, _) in GRAPH.items()}
SQL: dict[str, str] = {name: sql for name, (_, _, sql) in GRAPH.items()}
QUERIES |= {"node_by_id": _node_by_id, "edge_by_id": _edge_by_id, "edge_scan": _edge_scan, "project_endpoints": _endpoints, "empty_result": _empty}
SQL |= {
    "node_by_id": "SELECT o_orderkey AS o, o_orderstatus AS status FROM orders WHERE o_totalprice > 300000",
    "edge_by_id": "SELECT c_custkey AS c, c_nationkey::BIGINT AS n FROM customer WHERE c_acctbal > 0",
    "edge_scan": "SELECT o_custkey AS c, o_orderkey AS o FROM orders",
    "project_endpoints": "SELECT s_suppkey AS s, s_nationkey::BIGINT AS n FROM supplier",
    "empty_result": "SELECT n_name AS name FROM nation WHERE false",
}
