"""Stored response pages (one JSON document per row) to typed rows.

Every parser returns (rows, rejects): a page element that does not fit the
contract becomes a reject with a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOUBLE_NAMES = ("open", "high", "low", "close", "volume", "turnover")


def _elements(pages: DataFrame, body: str, schema: str, keep: list[str]) -> DataFrame:
    parsed = F.from_json(F.col(body), f"result struct<category: string, symbol: string, list: {schema}>, retCode long, retMsg string, time long")
    return pages.select(*keep, parsed.alias("__p")).select(
        *keep, F.col("__p.retCode").alias("ret_code"), F.col("__p.retMsg").alias("ret_msg"), F.col("__p.time").alias("page_time_ms"),
        F.col("__p.result.category").alias("page_category"), F.col("__p.result.symbol").alias("page_symbol"),
        F.posexplode_outer("__p.result.list").alias("position", "item"))


def _finite_text(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _candles(pages: DataFrame, width: int, body: str, mark: bool) -> tuple[DataFrame, DataFrame]:
    rows = _elements(pages, body, "array<array<string>>", []).where(F.col("item").isNotNull())
    item = F.col("item")
    at = lambda i: F.get(item, F.lit(i))
    names = DOUBLE_NAMES[:4] if mark else DOUBLE_NAMES
    typed = rows.select(
        F.col("page_symbol").alias("symbol"), F.col("page_category").alias("category"), at(0).try_cast("long").alias("open_time_ms"),
        *[_finite_text(at(i + 1)).alias(n) for i, n in enumerate(names)], F.size(item).alias("__n"), F.to_json(item).alias("raw_item"))
    short = (F.col("__n") < width) if mark else (F.col("__n") != width)
    unreadable = F.col("open_time_ms").isNull()
    for n in names:
        unreadable = unreadable | F.col(n).isNull()
    typed = typed.withColumn("reject_reason", F.when(short, "row_length_invalid").when(unreadable, "numeric_invalid"))
    good = typed.where(F.col("reject_reason").isNull())
    empty = [F.lit(None).cast("double").alias(n) for n in DOUBLE_NAMES[4:]] if mark else [F.col(n) for n in DOUBLE_NAMES[4:]]
    rows_out = good.select("symbol", "category", "open_time_ms", F.timestamp_millis("open_time_ms").alias("open_time_utc"), *DOUBLE_NAMES[:4], *empty,
                           F.lit("mark-price-kline" if mark else "kline").alias("source"))
    return rows_out, typed.where(F.col("reject_reason").isNotNull()).select("symbol", "raw_item", "reject_reason")


def candles_from_pages(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """``[time, open, high, low, close, volume, turnover]`` arrays of text."""
    return _candles(pages, 7, body, mark=False)


def mark_candles_from_pages(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Five-field variant; volume and turnover are NULL."""
    return _candles(pages, 5, body, mark=True)


def funding_from_pages(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Funding objects, unique on (symbol, time)."""
    schema = "array<struct<symbol: string, fundingRate: string, fundingRateTimestamp: string>>"
    rows = _elements(pages, body, schema, []).where(F.col("item").isNotNull())
    typed = rows.select(
        F.coalesce("item.symbol", "page_symbol").alias("symbol"), F.col("page_category").alias("category"),
        F.col("item.fundingRateTimestamp").try_cast("long").alias("funding_time_ms"), _finite_text(F.col("item.fundingRate")).alias("funding_rate"),
        F.to_json("item").alias("raw_item"))
    bad = F.col("funding_time_ms").isNull() | F.col("funding_rate").isNull()
    once = typed.where(~bad).groupBy("symbol", "category", "funding_time_ms").agg(F.min("funding_rate").alias("funding_rate"))
    return once.withColumn("source", F.lit("funding-history")), typed.where(bad).select("symbol", "raw_item", F.lit("numeric_invalid").alias("reject_reason"))


INSTRUMENT = (
    "array<struct<symbol: string, contractType: string, status: string, baseCoin: string, quoteCoin: string, settleCoin: string, "
    "launchTime: string, deliveryTime: string, isPreListing: boolean, fundingInterval: string, priceFilter: struct<tickSize: string>, "
    "lotSizeFilter: struct<qtyStep: string, minOrderQty: string, minNotionalValue: string>, "
    "leverageFilter: struct<minLeverage: string, maxLeverage: string, leverageStep: string>>>"
)


def instruments_from_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Nested price, lot and leverage filters flattened to the snapshot columns."""
    rows = _elements(pages, body, INSTRUMENT, []).where(F.col("item").isNotNull())
    i = lambda n: F.col(f"item.{n}")
    ms = lambda n: i(n).try_cast("long")
    dec = lambda n: i(n).try_cast("decimal(38,18)")
    return rows.select(
        F.col("page_time_ms").alias("snapshot_server_time_ms"), F.col("page_category").alias("category"), i("symbol"),
        i("contractType").alias("contract_type"), i("status"), i("baseCoin").alias("base_coin"), i("quoteCoin").alias("quote_coin"),
        i("settleCoin").alias("settle_coin"), ms("launchTime").alias("launch_time_ms"), ms("deliveryTime").alias("delivery_time_ms"),
        i("isPreListing").alias("is_pre_listing"), ms("fundingInterval").alias("funding_interval_minutes"), dec("priceFilter.tickSize").alias("tick_size"),
        dec("lotSizeFilter.qtyStep").alias("qty_step"), dec("lotSizeFilter.minOrderQty").alias("min_order_qty"),
        dec("lotSizeFilter.minNotionalValue").alias("min_notional_value"), dec("leverageFilter.minLeverage").alias("min_leverage"),
        dec("leverageFilter.maxLeverage").alias("max_leverage"), dec("leverageFilter.leverageStep").alias("leverage_step"))


def tickers_from_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    schema = "array<struct<symbol: string, turnover24h: string, volume24h: string, lastPrice: string>>"
    rows = _elements(pages, body, schema, []).where(F.col("item").isNotNull())
    return rows.select("item.symbol", "item.turnover24h", "item.volume24h", "item.lastPrice")


def fee_rows_from_response(pages: DataFrame, snapshot_id: str, category: str, body: str = "body") -> DataFrame:
    schema = "array<struct<symbol: string, makerFeeRate: string, takerFeeRate: string>>"
    rows = _elements(pages, body, schema, []).where(F.col("item").isNotNull())
    return rows.select(
        F.lit(snapshot_id).alias("fee_snapshot_id"), F.timestamp_millis("page_time_ms").alias("snapshot_utc"), F.lit(category).alias("category"),
        "item.symbol", "item.makerFeeRate", "item.takerFeeRate", "ret_code", "ret_msg", F.lit("account_actual").alias("source"))


def page_documents(rows: DataFrame, item: Column, symbol: Column, page_key: list, page_time: Column, category: str = "linear") -> DataFrame:
    """Response pages from rows: the inverse of the parsers, for tests and queries.

    ``page_key`` must give pages of bounded size.
    """
    keys = [f"__k{i}" for i, _ in enumerate(page_key)]
    cells = rows.select(*[c.alias(k) for c, k in zip(page_key, keys)], symbol.alias("__symbol"), page_time.alias("__t"), item.alias("__item"))
    listed = cells.groupBy(*keys, "__symbol").agg(F.collect_list("__item").alias("__list"), F.max("__t").alias("__t"))
    result = F.struct(F.lit(category).alias("category"), F.col("__symbol").alias("symbol"), F.col("__list").alias("list"))
    return listed.select(F.to_json(F.struct(
        F.lit(0).cast("long").alias("retCode"), F.lit("OK").alias("retMsg"), F.col("__t").alias("time"), result.alias("result"))).alias("body"))
