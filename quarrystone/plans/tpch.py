"""The decision-support catalogue, adapted to the star schema at hand.

The tables have no partsupp and lack some columns. What a query needs of them
is derived: offers of a part by a supplier come from the line items, a late
line is one shipped over 60 days after the order, and texts that are missing
are left out. Money is summed as decimals and returned rounded, so the result
does not depend on the order of summation.
"""

from __future__ import annotations


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def total(x: str, places: int = 2) -> str:
    return f"round(CAST(sum({x}) AS DOUBLE), {places})"


_NET = f"{money('l_extendedprice')} * (1 - {money('l_discount')})"
REVENUE = total(_NET, 4)
_PROFIT = f"{money('l_extendedprice')} * (1 - {money('l_discount')}) - ps_supplycost * {money('l_quantity')}"


def partsupp(where: str) -> str:
    """What suppliers offer, from what they shipped; ``where`` keeps the parts or suppliers that a query looks at, before they are grouped."""
    return (
        f"partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(CAST(floor(l_extendedprice / l_quantity / 2) AS DECIMAL(18,2))) AS ps_supplycost, "
        f"CAST(sum({money('l_quantity')}) AS DECIMAL(18,2)) AS ps_availqty FROM lineitem WHERE {where} GROUP BY l_partkey, l_suppkey)"
    )


def _parts(condition: str) -> str:
    return f"l_partkey IN (SELECT p_partkey FROM part WHERE {condition})"


_LATE = "l_shipdate > o_orderdate + INTERVAL 60 DAYS"

QUERIES = {
    "tpch_q1": f"""SELECT l_returnflag, l_linestatus, {total(money('l_quantity'))} AS sum_qty, {total(money('l_extendedprice'))} AS sum_base_price, {REVENUE} AS sum_disc_price,
        {total(_NET + " * (1 + " + money('l_tax') + ")", 4)} AS sum_charge, round(CAST(sum({money('l_quantity')}) AS DOUBLE) / count(*), 6) AS avg_qty,
        round(CAST(sum({money('l_discount')}) AS DOUBLE) / count(*), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""WITH {partsupp(_parts('p_size = 15'))}, offers AS (SELECT ps_partkey, ps_supplycost, s_suppkey, s_name, n_name, {money('s_acctbal')} AS acctbal FROM partsupp
        JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'),
        least AS (SELECT ps_partkey AS k, min(ps_supplycost) AS c FROM offers GROUP BY ps_partkey)
        SELECT CAST(acctbal AS DOUBLE) AS s_acctbal, s_name, n_name, p_partkey FROM part JOIN offers ON p_partkey = ps_partkey JOIN least ON k = p_partkey AND c = ps_supplycost WHERE p_size = 15""",
    "tpch_q3": f"""SELECT l_orderkey, {REVENUE} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate""",
    "tpch_q4": f"""SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_LATE}) GROUP BY o_orderpriority""",
    "tpch_q5": f"""SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
        AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name""",
    "tpch_q6": f"""SELECT {total(money('l_extendedprice') + " * " + money('l_discount'), 4)} AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND {money('l_discount')} BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {REVENUE} AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
        GROUP BY n1.n_name, n2.n_name, year(l_shipdate)""",
    "tpch_q8": f"""SELECT o_year, round(CAST(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 6) AS mkt_share FROM (
        SELECT CAST(year(o_orderdate) AS INT) AS o_year, {_NET} AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
        WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' AND p_type = 'ECONOMY') AS v GROUP BY o_year""",
    "tpch_q9": f"""WITH {partsupp(_parts("p_name LIKE '%rod%'"))} SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, {total(_PROFIT, 4)} AS sum_profit FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%rod%' GROUP BY n_name, year(o_orderdate)""",
    "tpch_q10": f"""SELECT c_custkey, c_name, {REVENUE} AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name""",
    "tpch_q11": f"""WITH {partsupp('l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)')}, stock AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)
        SELECT ps_partkey, {total('v', 4)} AS stock_value FROM stock GROUP BY ps_partkey HAVING sum(v) > (SELECT sum(v) * 0.001 FROM stock)""",
    "tpch_q12": f"""SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE {_LATE} AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY o_orderstatus""",
    "tpch_q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' AND o_totalprice > 150000
        GROUP BY c_custkey) AS c GROUP BY c_count""",
    "tpch_q14": f"""SELECT round(100 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_NET} ELSE 0 END) AS DOUBLE) / CAST(sum({_NET}) AS DOUBLE), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "tpch_q15": f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({_NET}) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, round(CAST(total_revenue AS DOUBLE), 4) AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q16": f"""WITH {partsupp(_parts("p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)"))} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
        WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": f"""SELECT round(CAST(sum({money('l_extendedprice')}) AS DOUBLE) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#3' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": f"""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {total(money('l_quantity'))} AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum({money('l_quantity')}) > 200) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice""",
    "tpch_q19": f"""SELECT {REVENUE} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
        OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    "tpch_q20": f"""WITH {partsupp(_parts("p_brand LIKE 'Brand#1%'"))}, shipped AS (SELECT l_partkey, l_suppkey, sum({money('l_quantity')}) AS q FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01' AND {_parts("p_brand LIKE 'Brand#1%'")} GROUP BY l_partkey, l_suppkey)
        SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN partsupp ON ps_suppkey = s_suppkey JOIN part ON p_partkey = ps_partkey
        JOIN shipped ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE p_brand LIKE 'Brand#1%' AND ps_availqty > 1.5 * q AND n_regionkey = 2""",
    "tpch_q21": f"""WITH late AS (SELECT l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND {_LATE})
        SELECT s_name, count(*) AS numwait FROM supplier JOIN late ON s_suppkey = late.l_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = late.l_orderkey AND l2.l_suppkey <> late.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM late l3 WHERE l3.l_orderkey = late.l_orderkey AND l3.l_suppkey <> late.l_suppkey) GROUP BY s_name""",
    "tpch_q22": f"""SELECT code, count(*) AS numcust, {total('bal')} AS totacctbal FROM (SELECT substring(c_name, 1, 10) AS code, {money('c_acctbal')} AS bal FROM customer
        WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND {money('c_acctbal')} > (SELECT CAST(sum({money('c_acctbal')}) AS DOUBLE) / count(*) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)) AS c GROUP BY code""",
}

#: The catalogue's reports with their order and limit, ties broken by key.
TOP = {
    "tpch_q2_top": "tpch_q2 ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100",
    "tpch_q3_top": "tpch_q3 ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
    "tpch_q10_top": "tpch_q10 ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q18_top": "tpch_q18 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100",
    "tpch_q21_top": "tpch_q21 ORDER BY numwait DESC, s_name LIMIT 100",
}
QUERIES |= {name: QUERIES[text.split(" ", 1)[0]] + " " + text.split(" ", 1)[1] for name, text in TOP.items()}
