"""Raw candle rows derived from the ``events`` table, for queries and tests.

Event times are cut to 15 minutes, so open times repeat; every 101st and 103rd event has a
junk or missing price, in turn null and each missing-value token, every 109th an odd number,
every 113th a trade count that is no plain integer; every 107th is all null, and one day has
unparseable trade counts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.schema import CANDLE_COLUMNS, NA_TOKENS, RAW_SCHEMA

ODD_FLOATS = ["inf", "-inf", "NaN", "1e39", "-1e39", "1.5d", "2.5F", "1e-3", "+7", "1 2"]
ODD_INTS = ["12.7", "1e3", "-3.9", "8.0"]


def _in_turn(values: list[str], every: int) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    place = f"cast(event_id div {every} % {len(values)} + 1 as int)"
    # below zero it counts from the end, and there is nothing at place 0, as in the SQL
    return f"case when {place} <> 0 then element_at(array({listed}), {place}) end"


def number_text(x: str) -> str:
    """A double as DuckDB spells it: the fewest digits that read back as the number, with an
    exponent (``1e+16``, ``1e-05``) from 1e16 up and below 1e-4 only, and ``inf`` and ``nan``.

    Spark's cast is that between 1e-3 and 1e7; beyond, it writes ``1.5E7`` and, at times, a digit
    more than needed. Powers of two from 5e17 up may have a digit more than in DuckDB.
    """
    java = f"cast({x} as string)"
    plain = rf"regexp_replace(cast(cast({java} as decimal(38, 22)) as string), r'(\.\d+?)0+$', '$1')"
    by_digits = f"transform(sequence(0, 16), d -> format_string(concat('%.', d, 'e'), {x}))"
    shortest = f"element_at(filter({by_digits}, t -> cast(t as double) = {x}), 1)"
    # Java rounds its own text of a number, which may be a digit off; a whole number is rounded here
    high = f"cast(floor(abs({x}) / 4294967296d) as bigint)"
    low = f"cast(abs({x}) - {high} * 4294967296d as bigint)"
    whole = f"cast(cast({high} as decimal(20, 0)) * 4294967296 + {low} as decimal(30, 0))"
    unit = "cast(rpad('1', length(cast(n as string)) - d + 1, '0') as decimal(30, 0))"
    rounded = f"concat((2 * n + {unit}) div (2 * {unit}), 'e', length(cast(n as string)) - d)"
    # few numbers have 15 digits or less; fewer than these need not be tried for the others
    tried = f"sequence(if(exists(array(15), d -> cast({rounded} as double) = abs({x})), 1, 16), 17)"
    exact = f"filter(transform({tried}, d -> {rounded}), t -> cast(t as double) = abs({x}))[0]"
    digits, places = "substring_index(t, 'e', 1)", "cast(substring_index(t, 'e', -1) as int)"
    spelled = rf"""concat(if({x} < 0, '-', ''), regexp_replace(rtrim('0', {digits}), r'^(.)(.+)$', '$1.$2'),
                          'e+', length({digits}) - 1 + {places})"""
    large = f"transform(transform(array({whole}), n -> {exact}), t -> {spelled})[0]"
    return f"""case when {x} is null or {x} = 0 or abs({x}) >= 1e-3 and abs({x}) < 1e7 then {java}
                    when isnan({x}) then 'nan'
                    when abs({x}) = double('infinity') then if({x} > 0, 'inf', '-inf')
                    when abs({x}) >= 1e-4 and abs({x}) < 1e16 then {plain}
                    when abs({x}) >= 5e17 and abs({x}) < 3e28 then {large}
                    else {shortest} end"""


_COLUMNS = {
    "open_time": "cast(slot as string)",
    "open": """case when event_id % 101 = 0 then 'abc'
                    when event_id % 206 = 0 then null
                    when event_id % 103 = 0 then """
    + _in_turn(NA_TOKENS, 103 * 2)
    + f" else {number_text('value')} end",
    "high": f"""case when event_id % 109 = 0 then {_in_turn(ODD_FLOATS, 109)}
                     else {number_text('(value + 1)')} end""",
    "low": number_text("(value / 2)"),
    "close": number_text("value"),
    "volume": "cast(user_id as string)",
    "close_time": "cast(slot + 899999 as string)",
    "quote_volume": number_text("(value * user_id)"),
    "trades": """case when event_type = 'error' and day(ts) = 13 and event_id % 5 = 0
                      then 'n/a'
                      when event_id % 113 = 0 then """
    + _in_turn(ODD_INTS, 113)
    + " else get_json_object(props, '$.k') end",
    "taker_buy_base": number_text("(user_id / 4)"),
    "taker_buy_quote": number_text("(value * user_id / 4)"),
    "extra": "'0'",
}


def raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the column has no zone; unix_millis wants one, and the session zone is UTC
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("slot", F.expr("unix_millis(ts) div 900000 * 900000"))
    text = [
        F.when(F.coalesce(F.col("event_id") % 107 != 0, F.lit(True)), F.expr(sql)).alias(name)
        for name, sql in _COLUMNS.items()
    ]
    return events.select(
        F.concat(F.upper("event_type"), F.lit("USDT")).alias("symbol"),
        F.lit("15m").alias("interval"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.lit("klines").alias("source"),
        F.col("event_id").alias("row_pos"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit(len(CANDLE_COLUMNS) + 1).alias("n_fields"),
        *text,
    ).select(*RAW_SCHEMA.fieldNames())
