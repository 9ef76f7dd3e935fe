"""Archive paths and object keys as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallow.schema import NO_INTERVAL


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def parse_day(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def archive_path(
    root: str, source: Column, symbol: Column, interval: Column, date: Column
) -> Column:
    """Where the archive of one day lies; without an interval the source names the file."""
    has_interval = interval.isNotNull() & (interval != "") & (interval != NO_INTERVAL)
    label = F.when(has_interval, interval).otherwise(source)
    name = F.concat(F.concat_ws("-", symbol, label, date), F.lit(".zip"))
    # concat_ws leaves out the null folder of the plain form
    return F.concat_ws(
        "/", F.lit(root.rstrip("/")), source, symbol, F.when(has_interval, interval), name
    )


def lake_path(prefix: str, source: str) -> str:
    return f"{prefix.rstrip('/')}/{source}"


# Signs that Spark writes as %XX in the name of a partition's folder.
_ESCAPED = "%\"#'*/:=?\\{[]^\x7f"


def _folder_value(value: Column) -> Column:
    for sign in _ESCAPED:
        value = F.replace(value, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return value


def day_folder(symbol: Column, interval: Column, date: Column) -> Column:
    """Folder of a day below that of its source, as Spark's partitioned writer names it."""
    values = {"symbol": symbol, "interval": F.coalesce(interval, F.lit(NO_INTERVAL)), "date": date}
    return F.concat_ws("/", *(F.concat(F.lit(f"{k}="), _folder_value(v)) for k, v in values.items()))


def partition_folder(
    prefix: str, source: Column, symbol: Column, interval: Column, date: Column
) -> Column:
    """Folder in which the sink stores a day."""
    root = F.concat(F.lit(lake_path(prefix, "")), source)
    return F.concat_ws("/", root, day_folder(symbol, interval, date))


def object_key(
    prefix: str, source: Column, symbol: Column, interval: Column, date: Column
) -> Column:
    """Key of the stored day. A missing interval is written as the text ``None``."""
    key = F.concat_ws(
        "/",
        F.lit(prefix.strip("/")),
        source,
        F.concat(F.lit("symbol="), symbol),
        F.concat(F.lit("interval="), F.coalesce(interval, F.lit(NO_INTERVAL))),
        F.concat(F.lit("date="), date),
        F.lit("data.parquet"),
    )
    return F.ltrim(key, F.lit("/"))
