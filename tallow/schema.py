"""Column lists, types and constants shared by every stage."""

from pyspark.sql import types as T

# Candle columns by position in the archive file.
CANDLE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "trades", "taker_buy_base", "taker_buy_quote",
]
FLOAT_COLUMNS = [
    "open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote",
]
INT_COLUMNS = ["open_time", "close_time", "trades"]

# Columns of a lake file, in file order.
OUTPUT_COLUMNS = [
    "timestamp", "open_time", "close_time", "open", "high", "low", "close",
    "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote",
]

# Text the CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# What tells a data row from a header, where a file may lack one. It reads the same in Java.
NUMBER_PATTERN = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"

# Milliseconds that fit a nanosecond timestamp, and the integer that stands
# for "no time" in that encoding.
MIN_EPOCH_MS = -9223372036854
MAX_EPOCH_MS = 9223372036854
NO_TIME = -9223372036854775808

# One day of one symbol. The order matters: windows over a day sort by these columns
# first, and the partitioned writer asks for (symbol, interval, date), so one sort serves
# both.
PARTITION_COLUMNS = ["symbol", "interval", "date"]
DAY_KEY = [*PARTITION_COLUMNS, "source"]

# Text for a missing interval in paths and partition values.
NO_INTERVAL = "None"


def _type_of(column: str) -> T.DataType:
    if column in FLOAT_COLUMNS:
        return T.FloatType()
    return T.TimestampType() if column == "timestamp" else T.LongType()


# What a scan yields: one row per CSV row, all text, plus one row per day that carries the
# fetch outcome in `status` and has no `row_pos`. `extra` is the first value past column
# 11 that is not a missing-value token; `n_fields` is the width of the file.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in DAY_KEY]
    + [
        T.StructField("row_pos", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("n_fields", T.IntegerType()),
    ]
    + [T.StructField(c, T.StringType()) for c in [*CANDLE_COLUMNS, "extra"]]
)

OUTPUT_SCHEMA = T.StructType([T.StructField(c, _type_of(c)) for c in OUTPUT_COLUMNS])

# Partition values are declared as text: inference would read interval 1d as 1.0.
LAKE_SCHEMA = T.StructType(
    OUTPUT_SCHEMA.fields + [T.StructField(c, T.StringType()) for c in PARTITION_COLUMNS]
)

FETCHED, ABSENT = "FETCHED", "ABSENT"
DONE, SKIP, ERROR = "DONE", "SKIP", "ERROR"
