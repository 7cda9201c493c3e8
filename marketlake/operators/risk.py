"""Risk rules as predicates over orders joined with the state of their account."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Limits that hold unless others are given.
LIMITS = {"drawdown": 0.1, "concentration": 0.3, "exposure": 0.95, "order_value": 500_000.0, "total_value": 5_000_000.0, "position": 10_000, "rate": 10, "var": 0.05}


def buy_value() -> Column:
    return F.when(F.col("side") == "BUY", F.col("quantity") * F.col("price")).otherwise(0.0)


def max_drawdown(limit: float) -> Column:
    return F.col("drawdown") > limit


def concentration(limit: float) -> Column:
    over = (F.col("largest_position") > limit * F.col("equity")) | (F.col("held_value") + buy_value() > limit * F.col("equity"))
    return F.when(F.col("equity") > 0, over).otherwise(F.lit(False))


def exposure(limit: float) -> Column:
    return F.when(F.col("equity") > 0, F.col("positions_value") + buy_value() > limit * F.col("equity")).otherwise(F.lit(False))


def order_limit(order: float, total: float) -> Column:
    return (buy_value() > order) | (F.col("positions_value") > total)


def position_size(limit: float) -> Column:
    change = F.when(F.col("side") == "BUY", F.abs("quantity")).otherwise(-F.abs("quantity"))
    return F.abs(F.abs("held_quantity") + change) > limit


def portfolio_risk(limit: float) -> Column:
    return F.coalesce(F.try_divide("positions_value", "equity") * F.col("volatility") * 1.65 > limit, F.lit(False))


def order_rate(account: str = "account", seconds: int = 60) -> Column:
    """Orders of an account within the last seconds, this one included; ts in whole seconds."""
    w = Window.partitionBy(account).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return F.count("*").over(w)


def default_rules(limits: dict | None = None) -> dict[str, Column]:
    m = LIMITS | (limits or {})
    return {
        "MaxDrawdown": max_drawdown(m["drawdown"]), "Concentration": concentration(m["concentration"]), "Exposure": exposure(m["exposure"]),
        "Limit": order_limit(m["order_value"], m["total_value"]), "MaxPositionSize": position_size(m["position"]), "PortfolioRisk": portfolio_risk(m["var"]),
    }


def check_orders(orders: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds results (rule, passed) in rule order, violations and approved."""
    results = F.array(*[F.struct(F.lit(n).alias("rule"), (~F.coalesce(c, F.lit(False))).alias("passed")) for n, c in rules.items()])
    out = orders.withColumn("results", results)
    out = out.withColumn("violations", F.transform(F.filter("results", lambda r: ~r["passed"]), lambda r: r["rule"]))
    return out.withColumn("approved", F.size("violations") == 0)


def check_totals(checked: DataFrame) -> DataFrame:
    """(rule, checks, passed, breaks) of each rule over all checked orders, and the same of all rules together as rule ``all``."""
    each = checked.select(F.explode("results").alias("r")).select("r.*")
    whole = checked.select(F.lit("all").alias("rule"), F.col("approved").alias("passed"))
    rows = each.unionByName(whole).groupBy("rule")
    return rows.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("breaks"))


def pre_trade_check(limits: dict | None = None) -> Column:
    """The first of drawdown, concentration, exposure and order value that fails; null if none."""
    m = LIMITS | (limits or {})
    checks = {"drawdown": max_drawdown(m["drawdown"]), "concentration": concentration(m["concentration"]), "exposure": exposure(m["exposure"]), "order_value": buy_value() > m["order_value"]}
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])


def simple_order_check(equity: Column, value_limit: float = 500_000.0, ratio: float = 0.3) -> tuple[Column, Column]:
    """(violations, level) of the plain rules: order value, share of equity bought, price and quantity positive."""
    value = F.col("price") * F.col("quantity")
    found = F.array_compact(F.array(
        F.when(value > value_limit, "order_value"), F.when((F.col("side") == "BUY") & (F.try_divide(value, equity) > ratio), "buy_ratio"),
        F.when(F.coalesce((F.col("price") <= 0) | (F.col("quantity") <= 0), F.lit(True)), "invalid"),
    ))
    return found, F.when(F.size(found) > 0, "HIGH").otherwise("LOW")


def portfolio_check(nav: DataFrame, limit: float = 0.1, warn: float = 0.08) -> DataFrame:
    """(strategy, drawdown, level) at the last row of each strategy."""
    w = Window.partitionBy("strategy").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = nav.withColumn("dd", 1 - F.try_divide(F.col("total_value"), F.max("total_value").over(w)))
    last = rows.groupBy("strategy").agg(F.max_by("dd", "ts").alias("drawdown"))
    return last.withColumn("level", F.when(F.col("drawdown") > limit, "HIGH").when(F.col("drawdown") > warn, "MEDIUM").otherwise("LOW"))


def alert_severity(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in ("HIGH", "CRITICAL", "MEDIUM", "WARNING", "LOW", "INFO")]), level)


def alerts(checked: DataFrame) -> DataFrame:
    """Alert rows (strategy, severity, message) of the portfolios whose level is not LOW."""
    message = F.format_string("drawdown %.4f", "drawdown")
    return checked.filter("level <> 'LOW'").select("strategy", alert_severity(F.col("level")).alias("severity"), message.alias("message"))


def circuit_breaker(checked: DataFrame, rejects: int = 3, cooldown: float = 300.0) -> DataFrame:
    """Adds broken and final approval per account in time order: after ``rejects`` rejections in a row everything is rejected for
    ``cooldown`` seconds, then counting starts anew. Sequential within an account; orders stream through in sorted batches."""
    cols = [F.col(c) for c in ("order_id", "account", "approved")] + [F.unix_micros(F.col("ts").cast("timestamp")).alias("us")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, streak, until = None, 0, 0
        for batch in batches:
            out = []
            for order, who, ok, us in batch[["order_id", "account", "approved", "us"]].itertuples(index=False):
                if who != account:
                    account, streak, until = who, 0, 0
                broken = us < until
                if not broken:
                    streak = 0 if ok else streak + 1
                    if streak >= rejects:
                        until, streak = us + int(cooldown * 1e6), 0
                out.append((order, who, broken, bool(ok and not broken)))
            yield pd.DataFrame(out, columns=["order_id", "account", "broken", "final"])

    rows = checked.select(*cols).repartition("account").sortWithinPartitions("account", "us", "order_id")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"order_id {kind['order_id']}, account {kind['account']}, broken boolean, final boolean")
