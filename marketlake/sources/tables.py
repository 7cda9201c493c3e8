"""News, factor values, symbols, financial statements and index snapshots as plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.sources.bars import upsert

#: Column names that vendors use, the first that exists counts; and their time formats.
TITLES, CONTENTS, TIMES = ("title", "标题", "headline"), ("content", "内容", "body", "text"), ("published_at", "datetime", "发布时间", "time", "date")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd")
STATEMENTS = ("income", "balance", "cashflow")


def parse_time(c: Column) -> Column:
    """A time in any of the formats; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


def normalize_news(df: DataFrame, source: str) -> DataFrame:
    """(news_id, title, content, source, published_at) from the first candidate columns that exist; the id is a hash of the
    source, time and text, so it does not depend on the order of rows."""

    def pick(names: tuple[str, ...]) -> Column:
        name = next((n for n in names if n in df.columns), None)
        return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")

    out = df.select(F.coalesce(pick(TITLES), F.lit("")).alias("title"), F.coalesce(pick(CONTENTS), F.lit("")).alias("content"), F.lit(source).alias("source"), parse_time(pick(TIMES)).alias("published_at"))
    return out.select(F.sha2(F.concat_ws("|", "source", F.col("published_at").cast("string"), "title", "content"), 256).alias("news_id"), "*")


def write_factor_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """(date, symbol, factor, value) with the new values in place of old ones."""
    return upsert(old, new, ["factor", "date", "symbol"])


def factor_series(values: DataFrame, symbol: str, factor: str, start: str, end: str) -> DataFrame:
    """Values of one symbol and factor in an inclusive range, in order of dates."""
    d = F.col("date")
    return values.filter((F.col("symbol") == symbol) & (F.col("factor") == factor) & d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date", "value").orderBy("date")


def list_symbols(symbols: DataFrame, names: DataFrame, status: str | None = None) -> DataFrame:
    """(symbol, exchange, name, status) in order of symbols; the exchange is the suffix."""
    out = symbols if status is None else symbols.filter(F.col("status") == status)
    out = out.join(names, "symbol", "left")
    return out.select("symbol", F.regexp_extract("symbol", r"\.([A-Z]+)$", 1).alias("exchange"), "name", "status").orderBy("symbol")


def statements(table: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """Financial statements of a kind by report period, in an inclusive range; an unknown kind is an error."""
    if kind not in STATEMENTS:
        raise ValueError(f"unknown statement {kind}")
    return table.filter((F.col("report_type") == kind) & F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def add_snapshot(old: DataFrame, new: DataFrame, day: Column) -> DataFrame:
    """Index members (snapshot_date, code, ...) with a day's snapshot, keyed by day and code, so days never replace each other."""
    return upsert(old, new.withColumn("snapshot_date", day), ["snapshot_date", "code"])
