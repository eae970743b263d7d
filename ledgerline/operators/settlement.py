"""Settlement: rate snapshots, the ledger, fees, payouts. Amounts are decimals throughout.

Functions of the source database whose bodies aren't known, such as tax rounding and tax rates, are parameters: callables
on Columns. Schedules of due dates are tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.expressions import MONEY, iif, in_list, round3
from ledgerline.operators.aggregate import net_zero_groups
from ledgerline.operators.joins import due_date, unique

#: States of a ledger row.
FULL, CANCEL, PARTIAL, REFUND = 0, 1, 2, 3


def rate_snapshot(contracts: DataFrame, rates: DataFrame, ymd: str, keys: list[str]) -> DataFrame:
    """Rates of a day: of active contracts and of those cancelled that day, with ymd."""
    active = contracts.where("use_state = 1")
    ended = contracts.where((F.col("use_state") != 1) & (F.col("cancel_ymd") == ymd))
    branch = lambda c, name: rates.join(c.select(*keys).distinct(), keys, "left_semi").withColumn("branch", F.lit(name))
    return branch(active, "active").unionByName(branch(ended, "cancelled")).withColumn("ymd", F.lit(ymd))


def commission(amount: Column, kind: Column, rate: Column, fixed: Column) -> Column:
    """Kind 1 takes a rate in percent of the amount, others a fixed amount."""
    return F.when(kind == 1, (amount.cast(MONEY) * rate.cast(MONEY) / 100).cast(MONEY)).otherwise(fixed.cast(MONEY))


def provider_cost(amount: Column, rate: Column, method: Column, flag: Column, sum_flag: Column, digits: int = 0) -> Column:
    """Provider's fee without tax. Method 0 rounds it as it is; others round the sum with a tenth of tax and take the tax
    out again."""
    fee = (amount.cast(MONEY) * rate.cast(MONEY) / 100).cast(MONEY)
    with_tax = round3((fee * F.lit("1.1").cast("decimal(3,1)")).cast(MONEY), digits, sum_flag)
    return F.when(method == 0, round3(fee, digits, flag)).otherwise((with_tax / F.lit("1.1").cast("decimal(3,1)")).cast("decimal(38,4)"))


def build_ledger(branches: dict[int, DataFrame], client_rates: DataFrame, pg_rates: DataFrame, properties: DataFrame, tax: Callable[[Column], Column]) -> DataFrame:
    """The ledger of a day from its branches (full, partial cancel, refund: ymd, client_id, pg_name, mall_id, tid, tx_amt),
    with client fee, tax and provider cost.

    Transactions without a rate drop out (see missing_rates); providers without properties use method 0. Cancels and
    refunds count with a negative amount.
    """
    rows = reduce(DataFrame.unionByName, (df.withColumn("use_state", F.lit(s)) for s, df in branches.items()))
    keys = ["ymd", "pg_name", "mall_id"]
    joined = rows.join(client_rates, [*keys, "client_id"]).join(pg_rates, keys).join(properties, "pg_name", "left")
    sign = iif(F.col("use_state").isin(CANCEL, PARTIAL, REFUND), F.lit(-1), F.lit(1))
    joined = joined.withColumn("tx_amt", (F.col("tx_amt") * sign).cast(MONEY))
    fee = commission(F.col("tx_amt"), F.col("commission_type"), F.col("commission_rate"), F.col("commission_amt") * sign)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = provider_cost(F.col("tx_amt"), F.col("pg_rate"), zero("comm_method"), zero("comm_round_flag"), zero("comm_sum_round_flag"))
    return joined.withColumns({"cl_comm": round3(fee, 0).cast(MONEY), "pg_comm": cost.cast(MONEY)}).withColumns({"cl_vt": tax(F.col("cl_comm")).cast(MONEY), "pg_vt": tax(F.col("pg_comm")).cast(MONEY)})


def ledger_totals(df: DataFrame) -> DataFrame:
    """Totals with tax, and income: what the client pays less what the provider costs."""
    df = df.withColumns({"cl_total": (F.col("cl_comm") + F.col("cl_vt")).cast(MONEY), "pg_total": (F.col("pg_comm") + F.col("pg_vt")).cast(MONEY)})
    return df.withColumn("income", (F.col("cl_total") - F.col("pg_total")).cast(MONEY))


def apply_minimum_fee(df: DataFrame, fee: str = "cl_comm", minimum: str = "min_commission_amt", tax: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fees below the minimum in absolute value raised to it, sign kept; fee type and tax follow the same test, which
    reads the row as it was."""
    low = F.coalesce((F.col(minimum) > 0) & (F.abs(F.col(fee)) < F.col(minimum)), F.lit(False))
    raised = (F.col(minimum) * iif(F.col("tx_amt") < 0, F.lit(-1), F.lit(1))).cast(MONEY)
    sets = {fee: iif(low, raised, F.col(fee)), "fee_type": iif(low, F.lit("minimum"), F.lit("regular"))}
    if tax:
        sets["cl_vt"] = iif(low, tax(raised).cast(MONEY), F.col("cl_vt"))
    return df.withColumns(sets)


def bracket_fee(df: DataFrame, amount: str, brackets: list[tuple[str, str]]) -> DataFrame:
    """df with bracket_fee: of (upper bound, fee) in rising order the fee of the first bound that the absolute amount
    doesn't exceed; null above the last. A null amount has no fee."""
    value, out = F.abs(F.col(amount)), F
    for bound, fee in brackets:
        out = out.when(value <= F.lit(bound).cast(MONEY), F.lit(fee).cast(MONEY))
    return df.withColumn("bracket_fee", out)


def update_from(target: DataFrame, source: DataFrame, on: list[str], set_: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: target rows that have a source row (and pass where) with new values; the others as they are.

    Assignments are Columns over target columns and, prefixed s_, the source's; all of them read the row before the
    update. Several source rows for a key would make the result a matter of chance, so they fail the job.
    """
    s = unique(source, on).select(*on, *(F.col(c).alias(f"s_{c}") for c in source.columns if c not in on), F.lit(True).alias("__matched"))
    hit = F.coalesce(F.col("__matched") & (where if where is not None else F.lit(True)), F.lit(False))
    new = [(F.when(hit, set_[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in set_ else F.col(c)) for c in target.columns]
    return target.join(s, on, "left").select(*new)


def apply_updates(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Updates one after another; each reads what the one before left."""
    return reduce(lambda now, step: step(now), steps, df)


def propagate_status(df: DataFrame, keys: DataFrame, key: list[str], column: str, value: object) -> DataFrame:
    """df with a status set on every row whose key is among keys."""
    hit = keys.select(*key).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).select(*df.columns)


def mark_collected(df: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Collection state and date: the period table's date, set back to open where it is blank; refunds never count."""
    dated = due_date(df.drop("in_ymd", "in_state"), periods, keys, "in_ymd")
    blank = F.coalesce(F.trim("in_ymd"), F.lit("")) == ""
    open_ = blank | (F.col("use_state") == REFUND)
    return dated.withColumns({"in_state": iif(open_, F.lit(0), F.lit(1)), "in_ymd": F.when(~open_, F.col("in_ymd"))})


def schedule_payout(df: DataFrame, schedule: DataFrame, keys: list[str], product: str, excluded: str, sep: str = ",") -> DataFrame:
    """Payout state and due date by the schedule; products of the excluded list are left for later, rows without a due
    date too."""
    dated = due_date(df.drop("out_ymd", "out_state"), schedule, keys, "out_ymd")
    due = F.col("out_ymd").isNotNull() & ~F.coalesce(in_list(F.col(product), excluded, sep), F.lit(False))
    return dated.withColumns({"out_state": iif(due, F.lit(1), F.lit(0)), "out_ymd": F.when(due, F.col("out_ymd"))})


def reload_guard(ledger: DataFrame, ymd: str) -> DataFrame:
    """One row: whether a day may be loaded again; not if any of its rows is paid out."""
    return ledger.where((F.col("ymd") == ymd) & (F.col("out_state") == 2)).limit(1).agg((F.count("*") == 0).alias("may_reload"))


def realign_components(df: DataFrame, whole: str, parts: list[str], rest: str) -> DataFrame:
    """Where parts don't add up to the whole, the rest part takes the difference."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(p), F.lit(0)) for p in parts))
    return df.withColumn(rest, F.when(total != F.col(whole), F.coalesce(F.col(rest), F.lit(0)) + F.col(whole) - total).otherwise(F.col(rest)).cast(df.schema[rest].dataType))


def component_cost(df: DataFrame, rates: DataFrame, keys: list[str], components: dict[str, str]) -> DataFrame:
    """df with cost: each component's amount times its own rate in percent, rounded one by one and added up. components
    maps amount columns to rate columns; a missing rate costs nothing."""
    joined = df.join(unique(rates, keys), keys, "left")
    cost = reduce(lambda a, b: a + b, (round3((F.coalesce(F.col(a), F.lit(0)).cast(MONEY) * F.coalesce(F.col(r), F.lit(0)).cast(MONEY) / 100).cast(MONEY), 0) for a, r in components.items()))
    return joined.withColumn("cost", cost.cast(MONEY)).select(*df.columns, "cost")


def instalment_interest(df: DataFrame, interest: DataFrame, tax: Callable[[Column], Column]) -> DataFrame:
    """Ledger rows of instalments (pg_name, months, tx_amt, cl_comm, pg_comm) with the interest added to fee and cost and
    the tax taken from the new sums. interest (pg_name, months, client_rate, cost_rate) in percent a month."""
    each = lambda rate: round3((F.col("tx_amt").cast(MONEY) * F.col("months") * F.col(rate).cast(MONEY) / 100).cast(MONEY), 0).cast(MONEY)
    keys = ["pg_name", "months"]
    fee, cost = F.col("cl_comm") + each("s_client_rate"), F.col("pg_comm") + each("s_cost_rate")
    return update_from(df, interest, keys, {"cl_comm": fee, "pg_comm": cost, "cl_vt": tax(fee.cast(MONEY)), "pg_vt": tax(cost.cast(MONEY))})


def foreign_rate(df: DataFrame, client_rates: DataFrame, pg_rates: DataFrame) -> DataFrame:
    """Rows paid by foreign card with fees by the foreign rates of client and provider."""
    fee = lambda rate: round3((F.col("tx_amt").cast(MONEY) * F.col(rate).cast(MONEY) / 100).cast(MONEY), 0).cast(MONEY)
    foreign = F.col("is_foreign") == 1
    now = update_from(df, client_rates, ["client_id"], {"cl_comm": fee("s_foreign_rate")}, foreign)
    return update_from(now, pg_rates, ["pg_name"], {"pg_comm": fee("s_foreign_rate")}, foreign)


def reverse_signs(df: DataFrame, cancelled: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Amounts of cancels, partial cancels and refunds made negative, but for keys in another cancel list; null keys in
    the list count for nothing, so that an odd list doesn't stop every row."""
    other = cancelled.select(*key).dropna().distinct().withColumn("__other", F.lit(True))
    turned = F.col("use_state").isin(CANCEL, PARTIAL, REFUND) & F.col("__other").isNull()
    return df.join(other, key, "left").withColumns({c: F.when(turned, -F.col(c)).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def cancel_fee(df: DataFrame, client_rates: DataFrame, pg_rates: DataFrame) -> DataFrame:
    """Cancelled rows with the provider's cancel fee as cost and, where the contract says so, as fee of the client."""
    ended = F.col("use_state").isin(CANCEL, PARTIAL)
    now = update_from(df, pg_rates, ["pg_name"], {"pg_comm": F.col("s_cancel_fee")}, ended)
    return update_from(now, client_rates, ["client_id"], {"cl_comm": F.when(F.col("s_cancel_flag") == 1, F.col("s_cancel_fee")).otherwise(0)}, ended)


def restore_net_zero_fee(df: DataFrame, rates: DataFrame, key: list[str]) -> DataFrame:
    """Main rows of payments whose partial cancels take them to zero: the fee is given back and the cancel fee charged."""
    gone = net_zero_groups(df.where(F.col("use_state").isin(FULL, PARTIAL)), key, "tx_amt").where("rows > 1").select(*key).withColumn("gone", F.lit(1))
    marked = update_from(df.withColumn("__gone", F.lit(0)), gone, key, {"__gone": F.lit(1)}, F.col("use_state") == FULL)
    return update_from(marked, rates, ["client_id"], {"cl_comm": F.col("s_cancel_fee")}, F.col("__gone") == 1).drop("__gone")


def missing_groups(ledger: DataFrame, summary: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """Groups of ledger rows that pass test and that the summary lacks."""
    return ledger.where(test).select(*keys).distinct().join(summary, keys, "left_anti")
