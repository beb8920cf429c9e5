"""Independent DuckDB SQL for each registered query (the correctness oracle).

Built from shared CTE fragments so each query reads the raw tables.  Kept
apart from the Spark code on purpose: nothing here calls the library.
"""

from __future__ import annotations

CUT = "TIMESTAMP '2001-01-01 00:00:00'"

SNAP0 = f"""
hist AS (
  SELECT o_custkey, COUNT(*) AS n_orders, MIN(o_orderdate) AS f, MAX(o_orderdate) AS l,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spend
  FROM orders WHERE o_orderdate < {CUT} GROUP BY o_custkey),
fut AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= {CUT}),
snap0 AS (
  SELECT c.c_custkey AS customer_id, r.r_name AS tenant_id, c.c_mktsegment AS contract, n.n_name AS nation,
         CAST(h.n_orders AS BIGINT) AS n_orders,
         CAST(date_diff('day', CAST(h.f AS DATE), DATE '2001-01-01') AS BIGINT) AS tenure_days,
         CAST(floor(date_diff('day', CAST(h.f AS DATE), DATE '2001-01-01') / 30.0) AS BIGINT) AS tenure_months,
         CAST(date_diff('day', CAST(h.l AS DATE), DATE '2001-01-01') AS BIGINT) AS recency_days,
         CAST(h.spend AS DOUBLE) / h.n_orders AS avg_order,
         CASE WHEN floor(date_diff('day', CAST(h.f AS DATE), DATE '2001-01-01') / 30.0) = 0 THEN ' '
              ELSE CAST(h.spend AS VARCHAR) END AS total_spend,
         CASE WHEN fu.o_custkey IS NULL THEN 'Yes' ELSE 'No' END AS natural_churn
  FROM customer c JOIN hist h ON h.o_custkey = c.c_custkey
  LEFT JOIN fut fu ON fu.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def hash_unit(salt: str, key: str) -> str:
    return (
        f"CAST(CAST('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE)"
        " / CAST(4294967296 AS DOUBLE)"
    )


SCORE = "CAST(recency_days AS DOUBLE) / (CAST(recency_days AS DOUBLE) + CAST(180 AS DOUBLE))"

SNAP = f"""{SNAP0},
snap AS (
  SELECT * EXCLUDE (natural_churn),
         CASE WHEN {hash_unit('churn:', 'customer_id')} < {SCORE} THEN 'Yes' ELSE 'No' END AS churn
  FROM snap0)"""

# cleaned snapshot: total_spend coerced, zero-tenure imputed
CLEAN = f"""{SNAP},
clean AS (
  SELECT * REPLACE (
    COALESCE(CASE WHEN tenure_months = 0 AND TRY_CAST(trim(total_spend) AS DOUBLE) IS NULL THEN avg_order
                  ELSE TRY_CAST(trim(total_spend) AS DOUBLE) END, 0.0) AS total_spend)
  FROM snap)"""


def split_cte(source: str = "clean", seed: int = 42, size: float = 0.2) -> str:
    return f"""
lab AS (SELECT churn AS label, COUNT(*) AS n FROM {source} GROUP BY churn),
cut AS (
  SELECT label, n,
         CASE WHEN t >= n THEN greatest(1, n // 2) ELSE t END AS n_test
  FROM (SELECT label, n, CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * {size}, 0) AS BIGINT)) ELSE 0 END AS t
        FROM lab)),
ordered AS (
  SELECT customer_id AS id, churn AS label,
         row_number() OVER (PARTITION BY churn ORDER BY md5('{seed}:' || CAST(customer_id AS VARCHAR)), customer_id) AS rn
  FROM {source}),
manifest AS (
  SELECT o.id, o.label, CASE WHEN o.rn <= c.n_test THEN 'test' ELSE 'train' END AS split
  FROM ordered o JOIN cut c ON o.label = c.label)"""


TEST_SCORED = f"""{CLEAN},{split_cte()},
test_scored AS (
  SELECT c.*, {SCORE} AS churn_probability,
         {SCORE} * c.avg_order AS expected_revenue_at_risk
  FROM clean c JOIN manifest m ON m.id = c.customer_id AND m.split = 'test')"""


def with_(body: str, select: str) -> str:
    return f"WITH {body.strip()}\n{select}"
