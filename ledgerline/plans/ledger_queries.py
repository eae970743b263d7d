"""Settlement over lineitem as a ledger: the flag is the state, the ship date the day, the order the payment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.expressions import MONEY, round3
from ledgerline.operators import settlement as L
from ledgerline.plans.catalogue import query
from ledgerline.plans.reconcile_queries import lines, money

KEY = ["l_orderkey", "l_linenumber"]
#: lineitem as a ledger in SQL; fees are a stand-in of 3.5 percent, cost 2 percent.
LEDGER = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity, CAST(l_extendedprice AS DECIMAL(19,4)) AS amt,
  CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS use_state, strftime(l_shipdate, '%Y%m%d') AS ymd,
  CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(19,4)) * CAST(0.035 AS DECIMAL(5,3)) AS DECIMAL(19,4)), 0) AS DECIMAL(19,4)) AS fee FROM lineitem)"""


def tax(x):
    """A tenth, rounded: a stand-in for the source database's function."""
    return round3((x.cast(MONEY) * F.lit("0.1").cast("decimal(2,1)")).cast(MONEY), 0)


def ledger(t):
    fee = round3((F.col("amt") * F.lit("0.035").cast("decimal(5,3)")).cast(MONEY), 0).cast(MONEY)
    return lines(t).withColumn("fee", fee).withColumn("tx_amt", F.col("amt"))


@query("stl_a_rate_snapshot", "SELECT n_nationkey, n_name, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') THEN 'active' END AS branch, '20240101' AS ymd FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT n_nationkey, n_name, 'cancelled', '20240101' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 100 = 0)")
def _(spark, t):
    contracts = t("customer").select(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("use_state"), F.when(F.col("c_custkey") % 100 == 0, "20240101").alias("cancel_ymd"))
    return L.rate_snapshot(contracts, t("nation").select("n_nationkey", "n_name"), "20240101", ["n_nationkey"])


#: The ledger that build_ledger makes of lineitem, in SQL: providers with odd numbers have method 1, whose rounded sum w with tax gives
#: w / 1.1 to four places, here in whole numbers as 100000 w / 11; provider's rates are 1 and 1.5 percent.
TAXED = "CAST(round(CAST({} * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(19,4)), 0) AS DECIMAL(19,4))"
UNTAXED = "CAST(CAST(sign({0}) * ((abs(CAST({0} AS BIGINT)) * 200000 + 11) // 22) AS BIGINT) / 10000.0 AS DECIMAL(19,4))"
BUILT = f"""
    r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 2 ELSE 3 END AS use_state, s_nationkey, p_size,
                 CAST(CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS DECIMAL(5,0)) AS sign, CAST(l_extendedprice AS DECIMAL(19,4)) AS a
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
    f AS (SELECT *, CAST(a * sign AS DECIMAL(19,4)) AS tx, CASE WHEN p_size % 2 = 1 THEN CAST(CAST(a * sign AS DECIMAL(19,4)) * CAST(0.025 AS DECIMAL(5,3)) AS DECIMAL(19,4)) ELSE CAST(100 * sign AS DECIMAL(19,4)) END AS fee,
                 CAST(CAST(a * sign AS DECIMAL(19,4)) * CASE WHEN s_nationkey % 3 = 0 THEN CAST(0.015 AS DECIMAL(5,3)) ELSE CAST(0.01 AS DECIMAL(5,3)) END AS DECIMAL(19,4)) AS pg FROM r),
    g AS (SELECT *, CAST(round(fee, 0) AS DECIMAL(19,4)) AS cl_comm, round(CAST(pg * CAST(1.1 AS DECIMAL(3,1)) AS DECIMAL(19,4)), 0) AS w FROM f),
    h AS (SELECT *, CASE WHEN s_nationkey % 2 = 0 THEN CAST(round(pg, 0) AS DECIMAL(19,4)) ELSE {UNTAXED.format("w")} END AS pg_comm FROM g),
    b AS (SELECT l_orderkey, l_linenumber, use_state, tx, cl_comm, pg_comm, {TAXED.format("cl_comm")} AS cl_vt, {TAXED.format("pg_comm")} AS pg_vt FROM h)"""


def built(t):
    """The ledger of all lines in three branches."""
    rows = lines(t).join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    rows = rows.select(F.lit("d").alias("ymd"), (F.col("p_size") % 2).alias("client_id"), F.col("s_nationkey").alias("pg_name"), F.lit(0).alias("mall_id"), "l_orderkey", "l_linenumber", "l_returnflag", F.col("amt").alias("tx_amt"))
    branches = {s: rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for s, f in ((L.FULL, "N"), (L.PARTIAL, "R"), (L.REFUND, "A"))}
    keys = t("nation").select(F.lit("d").alias("ymd"), F.col("n_nationkey").alias("pg_name"), F.lit(0).alias("mall_id"))
    client = keys.withColumn("client_id", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"commission_type": F.col("client_id"), "commission_rate": F.lit("2.5").cast(MONEY), "commission_amt": F.lit(100).cast(MONEY)})
    rates = keys.withColumn("pg_rate", F.when(F.col("pg_name") % 3 == 0, F.lit("1.5").cast(MONEY)).otherwise(F.lit(1).cast(MONEY)))
    # providers without properties, every fourth of them, use method 0
    properties = t("nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("pg_name"), (F.col("n_nationkey") % 2).alias("comm_method"), F.lit(0).alias("comm_round_flag"), F.lit(0).alias("comm_sum_round_flag"))
    return L.build_ledger(branches, client, rates, properties, tax)


@query("stl_b_build_ledger", f"WITH {BUILT} SELECT l_orderkey, l_linenumber, use_state, CAST(tx AS DOUBLE) AS tx_amt, CAST(cl_comm AS DOUBLE) AS cl_comm, CAST(pg_comm AS DOUBLE) AS pg_comm, CAST(cl_vt AS DOUBLE) AS cl_vt, CAST(pg_vt AS DOUBLE) AS pg_vt FROM b")
def _(spark, t):
    return built(t).select(*KEY, "use_state", "tx_amt", "cl_comm", "pg_comm", "cl_vt", "pg_vt")


@query(
    "stl_c_provider_cost",
    f"""
    WITH c AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(19,4)) * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(19,4)) AS fee FROM lineitem),
    w AS (SELECT *, round(CAST(fee * CAST(1.1 AS DECIMAL(3,1)) AS DECIMAL(19,4)), 0) AS w FROM c)
    SELECT l_orderkey, l_linenumber, CAST(round(fee, 0) AS DOUBLE) AS cost, CAST({UNTAXED.format("w")} AS DOUBLE) AS untaxed FROM w
    """,
)
def _(spark, t):
    cost = lambda method: L.provider_cost(F.col("amt"), F.lit(2), F.lit(method), F.lit(0), F.lit(0))
    return lines(t).select(*KEY, cost(0).alias("cost"), cost(1).alias("untaxed"))


@query("stl_d_minimum_fee", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN abs(fee) < 500 THEN 500 ELSE fee END AS DOUBLE) AS fee, CASE WHEN abs(fee) < 500 THEN 'minimum' ELSE 'regular' END AS fee_type FROM l")
def _(spark, t):
    return L.apply_minimum_fee(ledger(t).withColumn("min_commission_amt", F.lit(500).cast(MONEY)), "fee").select(*KEY, "fee", "fee_type")


@query("stl_e_bracket_fee", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN amt <= 10000 THEN 100 WHEN amt <= 30000 THEN 250.5 WHEN amt <= 60000 THEN 400 END AS DOUBLE) AS bracket_fee FROM l")
def _(spark, t):
    return L.bracket_fee(ledger(t), "amt", [("10000", "100"), ("30000", "250.5"), ("60000", "400")]).select(*KEY, "bracket_fee")


@query("stl_f_update_from", "SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' AND o_totalprice > 1000 THEN 'B' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(spark, t):
    source = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return L.update_from(t("orders"), source, ["o_custkey"], {"o_orderstatus": F.lit("B")}, (F.col("s_c_mktsegment") == "BUILDING") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_orderstatus")


@query("stl_g_apply_updates", "SELECT o_orderkey, CASE WHEN n_regionkey = 1 THEN 'Y' WHEN o_custkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _(spark, t):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = c.join(t("nation"), "n_nationkey").select("o_custkey", "n_regionkey")
    return L.apply_updates(t("orders"), [
        lambda df: L.update_from(df, c, ["o_custkey"], {"o_orderstatus": F.lit("X")}, F.col("o_custkey") % 2 == 0),
        lambda df: L.update_from(df, nations, ["o_custkey"], {"o_orderstatus": F.lit("Y")}, F.col("s_n_regionkey") == 1),
    ]).select("o_orderkey", "o_orderstatus")


@query("stl_h_propagate_status", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, t):
    returned = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.propagate_status(t("orders"), returned, ["o_orderkey"], "o_orderstatus", "R").select("o_orderkey", "o_orderstatus")


@query("stl_i_ledger_totals", f"WITH {BUILT} SELECT l_orderkey, l_linenumber, CAST(cl_comm + cl_vt AS DOUBLE) AS cl_total, CAST(pg_comm + pg_vt AS DOUBLE) AS pg_total, CAST(cl_comm + cl_vt - pg_comm - pg_vt AS DOUBLE) AS income FROM b")
def _(spark, t):
    return L.ledger_totals(built(t)).select(*KEY, "cl_total", "pg_total", "income")


PERIODS = "p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '2024' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') || '01' END AS d FROM supplier WHERE s_suppkey % 5 <> 0)"


def periods(t, name):
    d = F.concat(F.lit("2024"), F.lpad((F.col("s_suppkey") % 12 + 1).cast("string"), 2, "0"), F.lit("01"))
    return t("supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(d).alias(name))


@query("stl_j_mark_collected", f"WITH {LEDGER}, {PERIODS} SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(d, '') = '' OR use_state = 2 THEN 0 ELSE 1 END AS in_state, CASE WHEN coalesce(d, '') <> '' AND use_state <> 2 THEN d END AS in_ymd FROM l LEFT JOIN p ON s_suppkey = l_suppkey")
def _(spark, t):
    rows = ledger(t).withColumn("use_state", F.when(F.col("use_state") == 2, L.REFUND).otherwise(F.col("use_state")))
    return L.mark_collected(rows, periods(t, "in_ymd"), ["l_suppkey"]).select(*KEY, "in_state", "in_ymd")


@query("stl_k_schedule_payout", f"WITH {LEDGER}, {PERIODS} SELECT l_orderkey, l_linenumber, CASE WHEN d IS NOT NULL AND l_quantity NOT IN (1, 7) THEN 1 ELSE 0 END AS out_state, CASE WHEN l_quantity NOT IN (1, 7) THEN d END AS out_ymd FROM l LEFT JOIN p ON s_suppkey = l_suppkey")
def _(spark, t):
    rows = ledger(t).withColumn("product", F.col("l_quantity").cast("int").cast("string"))
    return L.schedule_payout(rows, periods(t, "out_ymd"), ["l_suppkey"], "product", "1,7").select(*KEY, "out_state", "out_ymd")


@query("stl_l_reload_guard", "SELECT count(*) = 0 AS may_reload FROM lineitem WHERE strftime(l_shipdate, '%Y%m%d') = '19950615' AND l_linestatus = 'F'")
def _(spark, t):
    return L.reload_guard(lines(t).withColumn("out_state", F.when(F.col("l_linestatus") == "F", 2).otherwise(1)), "19950615")


@query("stl_m_realign_components", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(amt - CAST(floor(amt * CAST(0.5 AS DECIMAL(2,1))) AS DECIMAL(19,4)) AS DOUBLE) AS point_amt FROM l")
def _(spark, t):
    rows = ledger(t).withColumns({"card_amt": F.floor(F.col("amt") * F.lit("0.5").cast("decimal(2,1)")).cast(MONEY), "point_amt": F.lit(7).cast(MONEY)})
    return L.realign_components(rows, "amt", ["card_amt", "point_amt"], "point_amt").select(*KEY, "point_amt")


@query("stl_n_component_cost", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN s_suppkey IS NULL THEN 0 ELSE round(CAST(amt * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(19,4)), 0) + round(CAST(fee * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(19,4)), 0) END AS DOUBLE) AS cost FROM l LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = l_suppkey")
def _(spark, t):
    rates = t("supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(2).cast(MONEY).alias("card_rate"), F.lit(1).cast(MONEY).alias("point_rate"))
    return L.component_cost(ledger(t), rates, ["l_suppkey"], {"amt": "card_rate", "fee": "point_rate"}).select(*KEY, "cost")


@query("stl_o_missing_groups", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem l WHERE l_quantity > 45 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_suppkey = l.l_suppkey AND s.l_returnflag = l.l_returnflag AND s.l_discount = 0.0)")
def _(spark, t):
    keys = ["l_suppkey", "l_returnflag"]
    return L.missing_groups(t("lineitem"), t("lineitem").where("l_discount = 0.0").select(*keys).distinct(), keys, F.col("l_quantity") > 45)


@query("stl_p_instalment_interest", f"WITH {LEDGER}, i AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN round(CAST(amt * l_linenumber * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(19,4)), 0) END AS x FROM l) SELECT l_orderkey, l_linenumber, CAST(fee + coalesce(x, 0) AS DOUBLE) AS cl_comm, CAST(CASE WHEN x IS NULL THEN 0 ELSE round(CAST((fee + x) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(19,4)), 0) END AS DOUBLE) AS cl_vt FROM i")
def _(spark, t):
    zero = F.lit(0).cast(MONEY)
    rows = ledger(t).withColumns({"pg_name": F.col("l_suppkey"), "months": F.col("l_linenumber"), "cl_comm": F.col("fee"), "pg_comm": zero, "cl_vt": zero, "pg_vt": zero})
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("months")
    interest = t("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("pg_name"), months, F.lit(1).cast(MONEY).alias("client_rate"), F.lit(1).cast(MONEY).alias("cost_rate"))
    return L.instalment_interest(rows, interest, tax).select(*KEY, "cl_comm", "cl_vt")


@query("stl_q_foreign_rate", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_discount > 0.05 AND l_suppkey % 2 = 0 THEN round(CAST(amt * CAST(0.04 AS DECIMAL(4,2)) AS DECIMAL(19,4)), 0) ELSE fee END AS DOUBLE) AS cl_comm, CAST(CASE WHEN l_discount > 0.05 THEN round(CAST(amt * CAST(0.03 AS DECIMAL(4,2)) AS DECIMAL(19,4)), 0) ELSE 0 END AS DOUBLE) AS pg_comm FROM l")
def _(spark, t):
    rows = ledger(t).withColumns({"client_id": F.col("l_suppkey"), "pg_name": F.col("l_suppkey"), "is_foreign": (F.col("l_discount") > 0.05).cast("int"), "cl_comm": F.col("fee"), "pg_comm": F.lit(0).cast(MONEY)})
    of = lambda name, rate: t("supplier").select(F.col("s_suppkey").alias(name), F.lit(rate).cast(MONEY).alias("foreign_rate"))
    return L.foreign_rate(rows, of("client_id", 4).where("client_id % 2 = 0"), of("pg_name", 3)).select(*KEY, "cl_comm", "pg_comm")


@query("stl_r_reverse_signs", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN use_state > 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN -amt ELSE amt END AS DOUBLE) AS amt FROM l")
def _(spark, t):
    other = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return L.reverse_signs(ledger(t), other, ["l_orderkey"], ["amt"]).select(*KEY, "amt")


@query("stl_s_cancel_fee", f"WITH {LEDGER} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN use_state > 0 THEN 30 ELSE 0 END AS DOUBLE) AS pg_comm, CAST(CASE WHEN use_state > 0 THEN CASE WHEN l_suppkey % 2 = 1 THEN 50 ELSE 0 END ELSE fee END AS DOUBLE) AS cl_comm FROM l")
def _(spark, t):
    rows = ledger(t).withColumns({"client_id": F.col("l_suppkey"), "pg_name": F.col("l_suppkey"), "cl_comm": F.col("fee"), "pg_comm": F.lit(0).cast(MONEY)})
    of = lambda name, fee: t("supplier").select(F.col("s_suppkey").alias(name), F.lit(fee).cast(MONEY).alias("cancel_fee"), (F.col("s_suppkey") % 2).alias("cancel_flag"))
    return L.cancel_fee(rows, of("client_id", 50), of("pg_name", 30)).select(*KEY, "pg_comm", "cl_comm")


@query("stl_t_restore_net_zero", f"WITH {LEDGER}, z AS (SELECT l_orderkey FROM l WHERE use_state IN (0, 2) GROUP BY 1 HAVING sum(CASE WHEN use_state = 0 THEN 1 ELSE -1 END) = 0 AND count(*) > 1) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN use_state = 0 AND l_orderkey IN (FROM z) THEN 25 ELSE fee END AS DOUBLE) AS cl_comm FROM l")
def _(spark, t):
    rows = ledger(t).withColumns({"client_id": F.col("l_suppkey"), "cl_comm": F.col("fee"), "tx_amt": F.when(F.col("use_state") == 0, 1).otherwise(-1).cast(MONEY)})
    rates = t("supplier").select(F.col("s_suppkey").alias("client_id"), F.lit(25).cast(MONEY).alias("cancel_fee"))
    return L.restore_net_zero_fee(rows, rates, ["l_orderkey"]).select(*KEY, "cl_comm")
