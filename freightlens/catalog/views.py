"""Shared SQL views for the reference answers: plain ANSI SQL over the driver's tables."""

SHIPMENTS = """
lines0 AS (
  SELECT l_orderkey, l_suppkey, cast(round(l_quantity) AS bigint) AS q, cast(round(l_discount*100) AS bigint) AS dc,
         cast(round(l_tax*100) AS bigint) AS tx,
         date_diff('day', lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate), l_shipdate) AS gap
  FROM lineitem),
lines AS (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp, cast(sum(q) AS bigint) AS qty,
         cast(sum(dc) AS bigint) AS ds, cast(sum(dc*dc) AS bigint) AS dss, max(dc) AS dmax, min(dc) AS dmin,
         cast(sum(tx) AS bigint) AS ts, cast(sum(tx*tx) AS bigint) AS tss, max(tx) AS tmax,
         coalesce(max(gap),0) AS max_gap, cast(sum(q*dc) AS bigint) AS vib
  FROM lines0 GROUP BY l_orderkey),
shipments AS (
  SELECT cast(o.o_orderkey AS varchar) AS shipment_id,
    cast(a.qty AS double)/cast(20 AS double) AS transit_days,
    cast(a.n AS int) AS door_opens,
    cast(least(3,a.n_supp) AS int) AS leg_count,
    cast(200*a.n+60*a.ds AS double)/cast(100*a.n AS double) AS temp_mean_c,
    cast(200+60*a.dmax AS double)/cast(100 AS double) AS temp_max_c,
    cast(200+60*a.dmin AS double)/cast(100 AS double) AS temp_min_c,
    CASE WHEN a.n=1 THEN cast(0 AS double)
         ELSE cast(0.6 AS double)*sqrt(cast(a.n*a.dss-a.ds*a.ds AS double)/cast(a.n*(a.n-1) AS double)) END AS temp_std_c,
    CASE WHEN o.o_orderkey % 125 = 0 THEN NULL ELSE cast(10 AS double)/cast(10+a.dmax-a.dmin AS double) END AS temp_recovery_rate,
    cast(30*a.n+5*a.ts AS double)/cast(100*a.n AS double) AS rh_mean,
    CASE WHEN a.n=1 THEN cast(0 AS double)
         ELSE cast(0.05 AS double)*sqrt(cast(a.n*a.tss-a.ts*a.ts AS double)/cast(a.n*(a.n-1) AS double)) END AS rh_std,
    CASE WHEN o.o_orderkey % 24 = 0 THEN NULL ELSE cast(30+5*a.tmax AS double)/cast(100 AS double) END AS rh_max,
    cast(o.o_orderkey % 3 AS int) AS package_type,
    cast(a.qty AS double) AS product_volume_l,
    cast(a.qty AS double)/cast(50*a.n AS double) AS fill_ratio,
    cast(o.o_custkey % 8 AS int) AS carrier_id,
    cast(c.c_nationkey % 5 AS int) AS origin_zone,
    cast(o.o_orderkey % 5 AS int) AS dest_zone,
    cast(a.max_gap AS double)/cast(100 AS double) AS sensor_gap_hours,
    cast(a.vib AS double)/cast(100 AS double) AS vibration_index,
    o.o_totalprice AS feature_x1,
    c.c_acctbal AS feature_x2,
    cast(CASE WHEN o.o_orderstatus='F' THEN 1 ELSE 0 END AS int) AS feature_x3,
    cast(CASE WHEN 500*(a.dmax-a.dmin)+35*a.qty+5*a.max_gap+2*((o.o_orderkey*7919)%2500) > 16400 THEN 1 ELSE 0 END AS int) AS silent_failure
  FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN lines a ON a.l_orderkey=o.o_orderkey)
"""

ORDERED = (
    "shipment_id transit_days door_opens leg_count temp_mean_c temp_max_c temp_min_c temp_std_c temp_recovery_rate "
    "rh_mean rh_std rh_max package_type product_volume_l fill_ratio carrier_id origin_zone dest_zone sensor_gap_hours "
    "vibration_index feature_x1 feature_x2 feature_x3 silent_failure"
).split()

_DAMAGE = {
    "leg_count": "CASE WHEN k%97=0 THEN '2.5' WHEN k%79=3 THEN '4' WHEN k%103=7 THEN '0' ELSE leg_count END",
    "transit_days": "CASE WHEN k%89=1 THEN 'n/a' ELSE transit_days END",
    "door_opens": "CASE WHEN k%83=2 THEN NULL ELSE door_opens END",
    "fill_ratio": "CASE WHEN k%73=4 THEN '1.2' ELSE fill_ratio END",
    "rh_mean": "CASE WHEN k%71=5 THEN '-0.1' ELSE rh_mean END",
    "product_volume_l": "CASE WHEN k%67=6 THEN '0' ELSE product_volume_l END",
    "temp_max_c": "CASE WHEN k%61=7 THEN '-50.5' ELSE temp_max_c END",
    "temp_std_c": "CASE WHEN k%53=9 THEN 'NaN' ELSE temp_std_c END",
    "shipment_id": "CASE WHEN k%59=8 THEN '' ELSE shipment_id END",
}

RAW = (
    "raw0 AS (SELECT cast(shipment_id AS bigint) AS k, "
    + ", ".join(f"cast({c} AS varchar) AS {c}" for c in ORDERED)
    + " FROM shipments),\nraw AS (SELECT k, "
    + ", ".join(f"{_DAMAGE.get(c, c)} AS {c}" for c in ORDERED)
    + " FROM raw0 CROSS JOIN (SELECT unnest([1,2]) AS copy) WHERE copy=1 OR k%113=10)\n"
)


def snap(expr: str) -> str:
    return f"floor(({expr})*1000000+0.5)/1000000"


def over(body: str, *views: str) -> str:
    """A query over the shipment view and any further views."""
    return "WITH " + ",\n".join([SHIPMENTS.strip(), *[v.strip() for v in views]]) + "\n" + body.strip()
