"""Bars: schema, construction from ticks, normalisation, scans and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("freq", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
        T.StructField("volume", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("vwap", T.DoubleType()),
    ]
)
PRICES = ("open", "high", "low", "close")
#: Spellings of frequencies in data files.
FREQUENCIES = {"1min": "1min", "m1": "1min", "min1": "1min", "5min": "5min", "m5": "5min", "min5": "5min", "15min": "15min", "m15": "15min", "min15": "15min", "30min": "30min", "m30": "30min", "min30": "30min", "60min": "60min", "m60": "60min", "min60": "60min", "daily": "day", "day": "day", "d": "day"}


def make_bars(df: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, unit: str) -> DataFrame:
    """Open, high, low, close, volume (rows) and amount per symbol and truncated time; one partial aggregation."""
    rows = df.select(symbol.alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts"), price.alias("p"), order.alias("o"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.count("*").alias("volume"), F.sum("p").alias("amount"),
    )


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )


def unify_symbol(s: Column) -> Column:
    """Exchange suffixes made uniform: .SS to .SH, a bare six-digit code gets .SH (first digit 5 or 6) or .SZ."""
    s = F.regexp_replace(F.upper(s), r"\.SS$", ".SH")
    return F.when(F.rlike(s, F.lit(r"^[56]\d{5}$")), F.concat(s, F.lit(".SH"))).when(F.rlike(s, F.lit(r"^\d{6}$")), F.concat(s, F.lit(".SZ"))).otherwise(s)


def from_fixed(c: Column) -> Column:
    """A price in ten-thousandths as a double."""
    return c / F.lit(10000.0)


def to_fixed(c: Column) -> Column:
    """A price as ten-thousandths, rounded half up."""
    return F.floor(c * 10000 + 0.5).cast("long")


def daily_close_time(day: Column, hour: int = 15) -> Column:
    """The closing time of a trading day."""
    return (day.cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOURS")).cast("timestamp_ntz")


def frequency_of_file(name: Column) -> Column:
    """The frequency in a file's name; longer minute counts are tested first, none means daily."""
    out = F.lit("day")
    for f in ("1min", "5min", "60min", "30min", "15min"):
        out = F.when(F.contains(F.lower(name), F.lit(f)), f).otherwise(out)
    return out


def frequency(value: Column) -> Column:
    """The frequency that a column's spelling stands for; null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FREQUENCIES.items() for x in kv]), F.lower(F.trim(value)))


def parse_bars_csv(lines: DataFrame, value: str = "value") -> DataFrame:
    """Columns of daily bars from csv lines ``symbol,date,open,high,low,close,volume[,amount]``; ok tells good lines.

    A line with fewer than seven fields, a bad date or a number that does not parse is kept with ok = false.
    """
    f = F.split(F.col(value), ",", -1)
    get = lambda i: F.get(f, F.lit(i))
    out = lines.select(
        "*", get(0).alias("symbol"), F.expr(f"try_to_date(get(split({value}, ',', -1), 1), 'yyyy-MM-dd')").alias("date"),
        *[get(i).try_cast("double").alias(c) for i, c in enumerate(PRICES, 2)], get(6).try_cast("double").cast("long").alias("volume"),
        F.coalesce(get(7).try_cast("double"), F.lit(0.0)).alias("amount"), F.lit(0.0).alias("vwap"),
    )
    good = (F.size(f) >= 7) & F.col("date").isNotNull() & F.col("volume").isNotNull()
    for c in PRICES:
        good = good & F.col(c).isNotNull()
    return out.withColumn("ok", good)


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all csv files of a folder, with file, freq and ok; header lines are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).filter(~F.startswith(F.lower("value"), F.lit("symbol,")))
    return parse_bars_csv(lines).withColumn("freq", frequency_of_file(F.col("file"))).drop("value")


def load_stats(parsed: DataFrame, by: str = "file") -> DataFrame:
    """Loaded and failed lines per file."""
    return parsed.groupBy(by).agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("failed"))


def read_bars_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One file, or folder of files, per symbol: 600519_SH.parquet is symbol 600519.SH; lower-case columns."""
    df = spark.read.parquet(path)
    name = F.regexp_replace(F.regexp_extract("_metadata.file_path", r"[/=]([^/=]+?)\.parquet(?:/[^/]*)?$", 1), "_", ".")
    return df.select(name.alias("symbol"), *[F.col(c).alias(c.lower()) for c in df.columns])


def export_bars_csv(bars: DataFrame, path: str) -> None:
    """Write csv files by symbol in the fixed order date, open, high, low, close, volume, amount."""
    cols = [F.date_format("ts", "yyyy-MM-dd").alias("date"), *PRICES, "volume", "amount"]
    bars.select("symbol", *cols).write.partitionBy("symbol").option("header", True).csv(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Archive layout: partitions freq and year, rows of a symbol together and in time order."""
    out = bars.withColumn("year", F.year("ts")).repartition("freq", "year", "symbol").sortWithinPartitions("symbol", "ts")
    out.write.mode("overwrite").partitionBy("freq", "year").parquet(path)


def write_bucketed(rows: DataFrame, table: str, buckets: int, key: str = "symbol", order: str = "ts", path: str | None = None) -> DataFrame:
    """A table of so many buckets by key, each one sorted file, and the table read back. Tables of the same buckets join, group and have windows by the key
    without a shuffle; joins by the key and more do so where ``spark.sql.requireAllClusterKeysForCoPartition`` is off. A key lies in one bucket."""
    out = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, order).mode("overwrite").format("parquet")
    (out.option("path", path) if path else out).saveAsTable(table)
    return rows.sparkSession.table(table)


def scan_bars(bars: DataFrame, symbol: str | None, start: str, end: str, days: bool = False) -> DataFrame:
    """Bars in an inclusive range; with ``days`` the end is a day and all of it counts."""
    last = F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") if days else F.lit(end).cast("timestamp_ntz")
    upper = F.col("ts") < last if days else F.col("ts") <= last
    df = bars.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & upper)
    return df.filter(F.col("symbol") == symbol) if symbol is not None else df


def scan_fields(bars: DataFrame, fields: tuple[str, ...] = (*PRICES, "volume", "amount")) -> DataFrame:
    """Long form (symbol, ts, field, value); unknown fields give nothing."""
    known = [f for f in fields if f in bars.columns]
    return bars.select("symbol", "ts", *[F.col(f).cast("double").alias(f) for f in known]).unpivot(["symbol", "ts"], known, "field", "value")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Old and new rows with the last one for each key; within one side the greatest ``sequence`` wins."""
    seq = [F.col(sequence)] if sequence else []
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col("__side").desc(), *[s.desc() for s in seq])
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__side")


def incremental_window(progress: DataFrame, keys: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, start, end) still to load: the day after the last one loaded, or the start; nothing where that is not before the end."""
    first = F.greatest(F.date_add("last_date", 1), F.lit(start).cast("date"))
    out = keys.join(progress, "symbol", "left").select("symbol", F.coalesce(first, F.lit(start).cast("date")).alias("start"), F.lit(end).cast("date").alias("end"))
    return out.filter("start < end")


def session_plan(keys: DataFrame, progress: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, day, open, close) of the business days of a range after each symbol's progress."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    plan = keys.withColumn("day", days).filter(F.dayofweek("day").between(2, 6)).join(progress, "symbol", "left")
    plan = plan.filter(F.col("last_date").isNull() | (F.col("day") > F.col("last_date")))
    return plan.select("symbol", "day", F.lit("09:30").alias("open"), F.lit("15:00").alias("close"))


def parse_bar_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """Bars from JSON messages with symbol, ts (ms), prices, volume and perhaps amount; ok tells complete messages.

    A price with a decimal point is a price, one without is in ten-thousandths already; the result is in ten-thousandths.
    """
    schema = "symbol string, ts long, open string, high string, low string, close string, volume long, amount double"
    j = lines.withColumn("j", F.from_json(value, schema)).select("*", "j.*").drop("j")
    fixed = lambda c: F.when(F.contains(F.col(c), F.lit(".")), to_fixed(F.col(c).try_cast("double"))).otherwise(F.col(c).try_cast("long"))
    out = j.select(value, "symbol", (F.col("ts") * 1000).alias("ts_us"), *[fixed(c).alias(c) for c in PRICES], "volume", F.coalesce("amount", F.lit(0.0)).alias("amount"))
    good = F.col("symbol").isNotNull() & F.col("ts_us").isNotNull() & F.col("volume").isNotNull()
    for c in PRICES:
        good = good & F.col(c).isNotNull()
    return out.withColumn("ok", good)


def parse_items_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a reply ``{"data":{"items":[[date, open, high, low, close, volume, amount], ...]}}``; dates are yyyyMMdd."""
    items = F.from_json(value, "data struct<items: array<array<string>>>")["data"]["items"]
    rows = lines.select(F.explode(items).alias("i"))
    num = [F.get("i", F.lit(n)).try_cast("double").alias(c) for n, c in enumerate((*PRICES, "volume", "amount"), 1)]
    return rows.select(F.expr("try_to_date(get(i, 0), 'yyyyMMdd')").alias("date"), *num)


def normalize_columns(df: DataFrame, names: dict[str, str], required: set[str], dates: tuple[str, ...] = ("date", "trade_date", "datetime")) -> DataFrame:
    """Vendor names to canonical ones, the first date column that exists as ``date``, amount as volume * close where absent."""
    df = df.withColumnsRenamed(names)
    day = next((d for d in dates if d in df.columns), None)
    if day is not None and day != "date":
        df = df.withColumnRenamed(day, "date")
    if missing := required - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df if "amount" in df.columns else df.withColumn("amount", F.col("volume") * F.col("close"))


def data_coverage(bars: DataFrame) -> DataFrame:
    """First and last time and number of bars per symbol and frequency."""
    return bars.groupBy("symbol", "freq").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("row_count"))


def append_rows(rows: DataFrame, path: str) -> DataFrame:
    """The table at the path, with the rows behind those it had."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def store_counted(parsed: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Store the rows that are ok; the stored table and how many rows were received, stored and failed, counted on the way."""
    seen = Observation("ingest")
    counts = [F.count("*").alias("received"), F.count_if("ok").alias("stored"), F.count_if(~F.col("ok")).alias("failed")]
    parsed.observe(seen, *counts).filter("ok").drop("ok").write.parquet(path)
    return parsed.sparkSession.read.schema(parsed.drop("ok").schema).parquet(path), seen.get


def latest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows for each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
