"""Column functions: normalisation, calendar keys, buckets, classifications, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ms(value: Column) -> Column:
    """Epoch milliseconds of text: seconds in [946684800, 4102444800), milliseconds from 946684800000, else ISO-8601 (UTC); else null."""
    number = value.try_cast("double")
    iso = F.unix_millis(F.try_to_timestamp(F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), value).otherwise(F.concat(value, F.lit("Z")))))
    return F.when(number.isNotNull(), F.when((number >= 946684800) & (number < 4102444800), F.floor(number * 1000)).when(number >= 946684800000, F.floor(number))).otherwise(iso).cast("long")


def trade_identity(explicit: Column, fields: list[Column], index: Column | None = None) -> Column:
    """id:<explicit id>, else ck:<sha256 of the fields joined by |>; nulls and zeros are empty text, but index keeps its 0."""
    plain = lambda f: F.coalesce(f.cast("string"), F.lit(""))
    text = F.concat_ws("|", *[F.when(plain(f).isin("0", "0.0"), "").otherwise(plain(f)) for f in fields], *([] if index is None else [plain(index)]))
    return F.when(F.length(explicit.cast("string")) > 0, F.concat(F.lit("id:"), explicit.cast("string"))).otherwise(F.concat(F.lit("ck:"), F.sha2(text, 256)))


def buy_fill_code(timestamp_ms: Column, size: Column, price: Column, key: Column) -> Column:
    """Why a fill is not usable: TIMESTAMP_INVALID before FIELD_INCOMPLETE; null if it is."""
    bad = size.isNull() | (size <= 0) | price.isNull() | (price < 0) | (price > 1) | key.isNull()
    return F.when(timestamp_ms.isNull() | (timestamp_ms <= 0), "TIMESTAMP_INVALID").when(bad, "FIELD_INCOMPLETE")


def slug_window(slug: Column, prefix: str, seconds: int) -> tuple[Column, Column]:
    """(start ms, end ms) that a slug of prefix and an aligned start in seconds names; else nulls."""
    start = F.regexp_extract(slug, f"^{prefix}([0-9]{{9,11}})$", 1).try_cast("long")
    start = F.when(start % seconds == 0, start * 1000)
    return start, start + seconds * 1000


def calendar_keys(ms: Column) -> dict[str, Column]:
    """day, hour and ISO week in UTC of epoch milliseconds, by arithmetic on days."""
    days = F.floor(ms / 86_400_000).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), date), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    return {"day": date.cast("string"), "hour": F.pmod(F.floor(ms / 3_600_000), F.lit(24)).cast("int"), "iso_week": week}


def up_price(outcome: Column, price: Column) -> Column:
    """A price in terms of the Up outcome."""
    return F.when(outcome == "Down", 1 - price).otherwise(price)


def direction(outcome: Column, side: Column) -> Column:
    """+1 where a fill bets on Up (BUY Up or SELL Down), else -1."""
    return F.when((outcome == "Up") == (side == "BUY"), 1).otherwise(-1)


def left_closed(value: Column, cuts: list[float], names: list[str]) -> Column:
    """names[i] for cuts[i] <= value < cuts[i+1]; the last name has no upper cut."""
    out = F.when(value < cuts[0], F.lit(None).cast("string"))
    for i, name in enumerate(names[:-1]):
        out = out.when(value < cuts[i + 1], name)
    return out.when(value.isNotNull(), names[-1])


def right_closed(value: Column, low: float, step: float, n: int) -> Column:
    """Index of (low + i*step, low + (i+1)*step], the lowest edge included; null outside."""
    i = F.greatest(F.ceil((value - low) / step) - 1, F.lit(0)).cast("int")
    return F.when((value >= low) & (i < n), i)


def lag_class(lag_ms: Column, bound: float = 100) -> Column:
    """SYNCHRONOUS within the bound, else who leads."""
    return F.when(F.abs(lag_ms) <= bound, "SYNCHRONOUS").when(lag_ms > 0, "BTC_LEAD").when(lag_ms < 0, "PM_LEAD")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order and once each."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, name) for c, name in pairs])))


def error_class(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first rule whose words a text holds, whatever the case; else OTHER."""
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for words, name in rules:
        out = out.when(F.lower(text).contains(words.lower()), name)
    return out.otherwise("OTHER")


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """sha256 of a row's named columns as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def depth(levels: Column, n: int) -> Column:
    """Sum of the sizes of the first n levels."""
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["size"])


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), null when both are 0."""
    return (bid - ask) / F.nullif(bid + ask, F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share, within [0, 1]; null for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.greatest(middle - half, F.lit(0.0)), F.least(middle + half, F.lit(1.0))
