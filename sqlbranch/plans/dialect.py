"""Queries in the dialect, with what they mean in DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sql.compile import Compiler
from ..sql.parser import parse
from ..types import kind_of
from .registry import _oracles, _queries, table


def run(spark: SparkSession, sf_dir: str, sql: str, params: dict | None = None) -> DataFrame:
    """A query of the dialect over the Parquet tables of a folder."""
    known: dict[str, tuple] = {}

    def lookup(name: str):
        if name not in known:
            df = table(spark, sf_dir, name)
            view = f"sqlbranch_{name}_{abs(hash(sf_dir)) % 10**9}"
            df.createOrReplaceTempView(view)
            known[name] = view, [(f.name, kind_of(f.dataType)) for f in df.schema]
        return known[name]

    return spark.sql(Compiler(lookup, params).query(parse(sql)[0])[0])


def dialect(name: str, sql: str, oracle: str | None = None, params: dict | None = None) -> None:
    """Registers a query; oracle: the same in DuckDB's SQL where that differs."""

    def query(spark, sf_dir):
        return run(spark, sf_dir, sql, params)

    query.__name__ = query.__qualname__ = name
    _queries[name] = query
    _oracles[name] = oracle or sql


# scans, projection, filters

dialect("scan_project", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < '1997-01-01'::timestamp", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < TIMESTAMP '1997-01-01'")
dialect("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
dialect("constant_scan", "SELECT 1 + 2 * 3 AS a, 'x''y' AS b, TRUE AS c, 1.5 AS d, -1.5 AS e", "SELECT CAST(7 AS BIGINT) AS a, 'x''y' AS b, TRUE AS c, CAST(1.5 AS DOUBLE) AS d, CAST(-1.5 AS DOUBLE) AS e")
dialect("star", "SELECT n.*, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
dialect("distinct_order_limit", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC, o_orderstatus LIMIT 5 OFFSET 2")
dialect("kleene_logic", "SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN TRUE END) AND (c_nationkey > 5) AS a, (CASE WHEN c_acctbal > 0 THEN TRUE END) OR (c_nationkey > 5) AS o, NOT (CASE WHEN c_acctbal > 0 THEN TRUE END) AS n FROM customer")
dialect("is_null", "SELECT count(*) AS n FROM (SELECT CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS b FROM customer) t WHERE b IS NULL")
dialect("in_list", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')")
dialect("between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 OR p_retailprice NOT BETWEEN 950 AND 1900")
dialect("like_ascii", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'BLUE%' AND p_name NOT LIKE '%p_n%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'BLUE%' AND p_name NOT ILIKE '%p_n%'")
dialect("int_div_mod", "SELECT o_orderkey, o_orderkey / (o_custkey % 5) AS q, o_orderkey % (o_custkey % 5) AS r FROM orders", "SELECT o_orderkey, CASE WHEN o_custkey % 5 != 0 THEN CAST(o_orderkey // (o_custkey % 5) AS BIGINT) END AS q, CASE WHEN o_custkey % 5 != 0 THEN CAST(o_orderkey % (o_custkey % 5) AS BIGINT) END AS r FROM orders")
dialect("real_division", "SELECT c_custkey, round(c_acctbal / (c_custkey % 3), 4) AS q FROM customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 != 0 THEN round(c_acctbal / (c_custkey % 3), 4) END AS q FROM customer")
dialect("overflow_is_null", "SELECT n_nationkey, 9223372036854775807 + n_nationkey AS s, 9223372036854775807 * n_nationkey AS m FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 9223372036854775807 END AS s, CASE WHEN n_nationkey < 2 THEN 9223372036854775807 * n_nationkey END AS m FROM nation")
dialect("concat_operator", "SELECT n_nationkey, n_name || '-' || n_regionkey AS tag FROM nation")
dialect("cast_or_null", "SELECT c_custkey, CAST(substr(c_name, 10) AS integer) AS digits, CAST(c_name AS integer) AS none, c_acctbal::integer AS whole, CAST(c_nationkey AS text) AS t, CAST(' 42 ' AS integer) AS trimmed, CAST('yes' AS boolean) AS b FROM customer WHERE c_custkey < 50", "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS digits, TRY_CAST(c_name AS BIGINT) AS none, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(c_nationkey AS VARCHAR) AS t, CAST(42 AS BIGINT) AS trimmed, TRUE AS b FROM customer WHERE c_custkey < 50")
dialect("case_when", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END")
dialect("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS BIGINT) AS code FROM orders")
dialect("named_parameter", "SELECT c_custkey FROM customer WHERE c_mktsegment = :segment AND c_nationkey < :top", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10", {"segment": "BUILDING", "top": 10})

# joins

dialect("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000")
dialect("join_three_way", "SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
dialect("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 180000")
dialect("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 150000")
dialect("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > 9000 AND c_acctbal > 9000")
dialect("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
dialect("join_without_on", "SELECT count(*) AS n FROM region INNER JOIN nation", "SELECT count(*) AS n FROM region CROSS JOIN nation")
dialect("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey + 1")
dialect("join_self", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
dialect("join_self_next", "SELECT a.o_orderkey, b.o_orderkey AS next_key FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_orderstatus = a.o_orderstatus")
dialect("join_using", "SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)")
dialect("join_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 170000)")
dialect("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
dialect("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
dialect("not_in_with_null", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey END FROM region)")

# aggregation

dialect("agg_global", "SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
dialect("agg_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 AND avg(l_quantity) > 1")
dialect("agg_group_expression", "SELECT o_orderkey % 7 AS k, sum(o_custkey) AS s FROM orders GROUP BY o_orderkey % 7", "SELECT o_orderkey % 7 AS k, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderkey % 7")
dialect("agg_having_hidden", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING max(c_acctbal) > 9500")
dialect("agg_arithmetic", "SELECT c_mktsegment, round(sum(c_acctbal) / count(*), 2) AS mean, max(c_custkey) - min(c_custkey) AS spread FROM customer GROUP BY c_mktsegment")
dialect("agg_in_function", "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS a, CASE WHEN count(*) > 280 THEN 'many' ELSE 'few' END AS size FROM customer GROUP BY c_mktsegment")
dialect("agg_case_sum", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open FROM orders GROUP BY o_orderpriority")
dialect("agg_distinct", "SELECT p_brand, count(DISTINCT p_size) AS sizes, sum(DISTINCT p_size) AS total FROM part GROUP BY p_brand", "SELECT p_brand, count(DISTINCT p_size) AS sizes, CAST(sum(DISTINCT p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
dialect("agg_nulls", "SELECT count(b) AS n, round(sum(b), 2) AS s, min(b) AS low FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS b FROM customer) t")
dialect("agg_empty", "SELECT count(*) AS n, max(c_custkey) AS m FROM customer WHERE c_custkey < 0")

# windows

dialect("win_row_number", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer")
dialect("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
dialect("win_lag_lead", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events")
dialect("win_whole_partition", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS total, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders")
dialect("win_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM orders")
dialect("win_over_groups", "SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM customer GROUP BY c_nationkey")
dialect("win_in_expression", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) + 100 AS k FROM nation")

# order and limits

dialect("order_nulls_low", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS b FROM customer ORDER BY b, c_custkey", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS b FROM customer ORDER BY b NULLS FIRST, c_custkey")
dialect("order_desc_nulls", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC, c_custkey", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS b FROM customer ORDER BY b DESC NULLS LAST, c_custkey")
dialect("order_by_expression", "SELECT p_partkey FROM part ORDER BY p_size % 10 DESC, p_partkey LIMIT 20 OFFSET 5")
dialect("order_by_aggregate", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 7")

# set operations, CTEs, subqueries

dialect("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
dialect("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
dialect("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
dialect("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
dialect("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
dialect("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
dialect("set_op_chain", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT 1 UNION SELECT 1 INTERSECT SELECT 2 ORDER BY k LIMIT 20")
dialect("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
dialect("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
dialect("scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS top FROM customer")
dialect("exists_correlated", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
dialect("in_nested", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 190000))")
dialect("derived_table", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM orders) t GROUP BY k")

# functions

dialect("fn_case_and_length", "SELECT doc_id, length(text) AS n, length(upper(lang)) AS m, lower(upper(source)) AS s FROM documents")
dialect("fn_substr_clamped", "SELECT n_nationkey, substr(n_name, 0, 2) AS a, substr(n_name, -3, 4) AS b, substr(n_name, 3) AS c, substr(n_name, 2, -1) AS d FROM nation", "SELECT n_nationkey, substr(n_name, 1, 2) AS a, substr(n_name, 1, 4) AS b, substr(n_name, 3) AS c, '' AS d FROM nation")
dialect("fn_trim", "SELECT n_nationkey, trim('  ' || n_name || '\n\t ') AS a, ltrim('  ' || n_name || ' ') AS b, rtrim(n_name || ' \t') AS c FROM nation", "SELECT n_nationkey, n_name AS a, n_name || ' ' AS b, n_name AS c FROM nation")
dialect("fn_replace_instr", "SELECT p_partkey, replace(p_name, 'e', '3') AS a, instr(p_name, 'l') AS b FROM part")
dialect("fn_concat_null", "SELECT c_custkey, concat(c_name, '/', c_nationkey) AS a, concat(c_name, CASE WHEN c_acctbal > 0 THEN 'x' END) AS b FROM customer", "SELECT c_custkey, c_name || '/' || c_nationkey AS a, CASE WHEN c_acctbal > 0 THEN c_name || 'x' END AS b FROM customer")
dialect("fn_hex_quote", "SELECT n_nationkey, hex(n_name) AS h, quote(n_name || '''s') AS q, quote(n_nationkey) AS k FROM nation", "SELECT n_nationkey, hex(n_name) AS h, '''' || n_name || '''''s''' AS q, CAST(n_nationkey AS VARCHAR) AS k FROM nation")
dialect("fn_abs_round", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, round(c_acctbal, 1) AS one, round(c_custkey) AS k FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) AS r, sign(c_acctbal) * floor(abs(c_acctbal) * 10 + 0.5) / 10 AS one, c_custkey AS k FROM customer")
dialect("fn_scalar_min_max", "SELECT n_nationkey, min(n_nationkey, n_regionkey) AS a, max(n_nationkey, CASE WHEN n_regionkey > 1 THEN 7 END) AS b FROM nation", "SELECT n_nationkey, least(n_nationkey, n_regionkey) AS a, CAST(CASE WHEN n_regionkey > 1 THEN greatest(n_nationkey, 7) END AS BIGINT) AS b FROM nation")
dialect("fn_null_handling", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0) AS a, ifnull(CASE WHEN c_custkey > 70 THEN 1 END, 2) AS b, nullif(c_mktsegment, 'BUILDING') AS c FROM customer", "SELECT c_custkey, CAST(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0) AS DOUBLE) AS a, CAST(ifnull(CASE WHEN c_custkey > 70 THEN 1 END, 2) AS BIGINT) AS b, nullif(c_mktsegment, 'BUILDING') AS c FROM customer")
dialect("fn_typeof", "SELECT typeof(n_nationkey) AS a, typeof(n_name) AS b, typeof(1.5) AS c, typeof(TRUE) AS d, typeof(NULL) AS e, count(*) AS n FROM nation GROUP BY typeof(n_nationkey), typeof(n_name)", "SELECT 'integer' AS a, 'text' AS b, 'real' AS c, 'boolean' AS d, 'null' AS e, count(*) AS n FROM nation")
dialect("fn_date_parts", "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, datetime(o_orderdate) AS dt, strftime('%Y/%m', o_orderdate) AS ym, strftime('%j-%w %H:%M:%S %%', o_orderdate) AS rest FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt, strftime(o_orderdate, '%Y/%m') AS ym, strftime(o_orderdate, '%j-%w %H:%M:%S %%') AS rest FROM orders")
dialect("fn_unixepoch", "SELECT event_id, unixepoch(ts) AS u, julianday(date(ts)) AS j FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u, CAST(epoch(CAST(ts AS DATE)) / 86400 + 2440587.5 AS DOUBLE) AS j FROM events")
dialect("fn_date_modifiers", "SELECT o_orderkey, date(o_orderdate, '+1 month') AS m, date(o_orderdate, 'start of month', '-1 day') AS e, date(o_orderdate, 'start of year', '+2 years') AS y, datetime(o_orderdate, '+36 hours', '-5 minutes', '+7 seconds') AS h, date(o_orderdate, 'nonsense') AS x FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS e, strftime(date_trunc('year', o_orderdate) + INTERVAL 2 YEAR, '%Y-%m-%d') AS y, strftime(o_orderdate + INTERVAL 36 HOUR - INTERVAL 5 MINUTE + INTERVAL 7 SECOND, '%Y-%m-%d %H:%M:%S') AS h, CAST(NULL AS VARCHAR) AS x FROM orders")
dialect("fn_date_text", "SELECT n_nationkey, date('2024-01-31', '+1 month') AS a, datetime('2024-03-05T06:07') AS b, time('10:11') AS c, date('rubbish') AS d, unixepoch('1970-01-02') AS e, datetime(86399) AS f FROM nation", "SELECT n_nationkey, '2024-02-29' AS a, '2024-03-05 06:07:00' AS b, '10:11:00' AS c, CAST(NULL AS VARCHAR) AS d, CAST(86400 AS BIGINT) AS e, '1970-01-01 23:59:59' AS f FROM nation")
dialect("fn_vector_distance", "SELECT a.vec_id, round(vector_distance(a.embedding, b.embedding), 4) AS l2, round(vec_distance(a.embedding, b.embedding, 'cosine'), 4) AS cosine, vector_dims(a.embedding) AS dims, round(vector_norm(a.embedding), 4) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = 0", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS l2, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine, len(a.embedding) AS dims, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 4) AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
dialect("fn_vector_text", "SELECT round(vector_distance('[1, 2, 3]', '[4, 6, 3]'), 6) AS l2, vector_distance([1, 0], [0, 2], 'cosine') AS c, vector_dims('[1,2]') AS d, vector_distance('[1]', '[1,2]') AS x", "SELECT CAST(5 AS DOUBLE) AS l2, CAST(1 AS DOUBLE) AS c, CAST(2 AS BIGINT) AS d, CAST(NULL AS DOUBLE) AS x")
dialect("vector_top_k", "SELECT a.vec_id, a.label FROM embeddings a JOIN embeddings b ON b.vec_id = 7 ORDER BY vector_distance(a.embedding, b.embedding), a.vec_id LIMIT 10", "SELECT a.vec_id, a.label FROM embeddings a JOIN embeddings b ON b.vec_id = 7 ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), a.vec_id LIMIT 10")
