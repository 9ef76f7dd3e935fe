"""The same queries as SQL over the ``events`` table, for an independent engine."""

KEY = 'symbol, "interval", "date", source'
TEXT = (
    'open_time, "open", high, low, "close", volume, close_time, quote_volume, trades, '
    "taker_buy_base, taker_buy_quote, extra"
)
CANDLE = TEXT.removesuffix(", extra")
OUTPUT = (
    '"timestamp", open_time, close_time, "open", high, low, "close", volume, quote_volume, '
    "trades, taker_buy_base, taker_buy_quote"
)

_NA_LIST = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
    "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)

# Raw candle rows, as in the fixture.
RAW = f"""
with r as (
 select event_id row_pos, 'klines' source, upper(event_type)||'USDT' symbol, '15m' "interval",
  strftime(ts,'%Y-%m-%d') "date",
  cast(epoch_ms(ts)//900000*900000 as varchar) open_time,
  case when event_id%101=0 then 'abc' when event_id%206=0 then null
       when event_id%103=0 then list_extract([{_NA_LIST}], cast(event_id//206%19+1 as int))
       else cast(value as varchar) end "open",
  case when event_id%109=0
       then list_extract(['inf','-inf','NaN','1e39','-1e39','1.5d','2.5F','1e-3','+7','1 2'],
                         cast(event_id//109%10+1 as int))
       else cast(value+1 as varchar) end high, cast(value/2 as varchar) low, cast(value as varchar) "close",
  cast(user_id as varchar) volume,
  cast(epoch_ms(ts)//900000*900000+899999 as varchar) close_time,
  cast(value*user_id as varchar) quote_volume,
  case when event_type='error' and day(ts)=13 and event_id%5=0 then 'n/a'
       when event_id%113=0
       then list_extract(['12.7','1e3','-3.9','8.0'], cast(event_id//113%4+1 as int))
       else json_extract_string(props,'$.k') end trades,
  cast(user_id/4 as varchar) taker_buy_base, cast(value*user_id/4 as varchar) taker_buy_quote,
  '0' extra
 from events),
raw_candles as (
 select row_pos, source, symbol, "interval", "date",
  if(row_pos%107=0,null,open_time) open_time, if(row_pos%107=0,null,"open") "open",
  if(row_pos%107=0,null,high) high, if(row_pos%107=0,null,low) low,
  if(row_pos%107=0,null,"close") "close", if(row_pos%107=0,null,volume) volume,
  if(row_pos%107=0,null,close_time) close_time, if(row_pos%107=0,null,quote_volume) quote_volume,
  if(row_pos%107=0,null,trades) trades, if(row_pos%107=0,null,taker_buy_base) taker_buy_base,
  if(row_pos%107=0,null,taker_buy_quote) taker_buy_quote, if(row_pos%107=0,null,extra) extra
 from r)"""

# 2^128 less half the last place of a float, and more, is infinite as a float. DuckDB takes a
# number with a sign before it or spaces around it; so does the job.
_LARGEST = "3.4028235677973366e38"


def _float(c: str) -> str:
    d = f"try_cast({c} as double)"
    return (
        f"case when {c} in ({_NA_LIST}) or isnan({d}) then null "
        f"when {d} >= {_LARGEST} then 'inf'::float when {d} <= -{_LARGEST} then '-inf'::float "
        f"else cast({d} as float) end {c}"
    )


FLOATS = ", ".join(
    _float(c)
    for c in [
        '"open"', "high", "low", '"close"', "volume", "quote_volume",
        "taker_buy_base", "taker_buy_quote",
    ]
)
INTS = ", ".join(
    f"cast(trunc(try_cast({c} as double)) as bigint) {c}"
    for c in ["open_time", "close_time", "trades"]
)
PRESENT = f"coalesce({TEXT}) is not null"

# Typed rows; rows of sound days; the first row of each open time.
TYPED = f"""{RAW},
typed as (select {KEY}, row_pos, {INTS}, {FLOATS} from raw_candles where {PRESENT}),
judged as (
 select *, max(case when open_time is null or close_time is null or trades is null
                    then 1 else 0 end) over (partition by {KEY}) bad
 from typed),
gated as (select * exclude (bad) from judged where bad = 0),
ranked as (
 select *, epoch_ms(open_time) "timestamp",
  row_number() over (partition by {KEY}, open_time order by row_pos) nth
 from gated),
candles as (select * from ranked where nth = 1)"""

CANDLES = f"{TYPED} select {KEY}, {OUTPUT} from candles"

# The grid: every symbol on every day between the first and last event.
GRID = """
with spine as (
 select strftime(unnest(generate_series(lo, hi, interval 1 day)), '%Y-%m-%d') "date"
 from (select cast(min(ts) as date) lo, cast(max(ts) as date) hi from events)),
symbols as (select distinct upper(event_type)||'USDT' symbol from events),
grid as (select symbol, '15m' "interval", "date", 'klines' source from symbols, spine)"""

GRID_AND_UNKNOWN = GRID + """,
wide_grid as (
 select * from grid
 union all select 'NOSUCHUSDT', '15m', "date", 'klines' from spine)"""

DAY_STATS = f"""typed_stats as (
 select {KEY}, count(*) n_rows,
  max(case when try_cast(trades as double) is null then 'trades is not an integer' end) problem
 from raw_candles where {PRESENT} group by all)"""


def _with(*blocks: str) -> str:
    """Several WITH clauses as one."""
    return "with " + ", ".join(b.strip().removeprefix("with ") for b in blocks)


# The days of one symbol of which the fixture writes no archive.
LEFT_OUT = "(symbol = 'CLICKUSDT' and \"date\"[9:] = '17')"


def _archived(where: str = "true") -> str:
    text = ", ".join(f"coalesce({c}, '') {c}" for c in CANDLE.split(", "))
    return f"""{RAW}
select {KEY}, {_POSITION} row_pos, {text}, extra from raw_candles where {where}"""


_POSITION = f"row_number() over (partition by {KEY} order by row_pos) - 1"
_CLOSE_TWICE = """cast(if(day(cast("date" as date)) <= 15, 2, 1) * "close" as float) "close\""""
_NO_TIME = "symbol = 'CLICKUSDT' and \"date\" = '2024-01-01'"
_NA_TO_NULL = ", ".join(
    f"case when {c} not in ({_NA_LIST}) then {c} end {c}" for c in TEXT.split(", ")
)

ORACLES = {
    "candle_normalize": CANDLES,
    "reorder_columns": CANDLES,
    "partitioned_sink_roundtrip": CANDLES,
    "partition_overwrite_idempotent": f"""{TYPED}
select {KEY}, {OUTPUT.replace('"close"', _CLOSE_TWICE)} from candles""",
    "archive_scan": _archived(f"not {LEFT_OUT}"),
    "candle_archive_source": _archived(f"not {LEFT_OUT}"),
    "candle_archive_pushdown": f"""{_with(GRID_AND_UNKNOWN, RAW)},
archived as (
 select {KEY}, {_POSITION} row_pos, null status, {", ".join(f"coalesce({c}, '') {c}" for c in CANDLE.split(", "))}, extra
 from raw_candles where not {LEFT_OUT}),
statuses as (
 select {KEY}, null::bigint row_pos,
  case when exists (select 1 from archived a where a.symbol = g.symbol and a."date" = g."date")
       then 'FETCHED' else 'ABSENT' end status,
  {", ".join(f"null {c}" for c in TEXT.split(", "))}
 from wide_grid g)
select * from (select * from archived union all select * from statuses)
where symbol <> 'ERRORUSDT' and "date" between '2024-01-10' and '2024-01-19'""",
    # a first row without any number passes for a header
    "headerless_archive_scan": f"""{RAW},
rows_in_file as (select *, {_POSITION} nth, {PRESENT} present from raw_candles)
select {KEY}, {_POSITION} row_pos, {", ".join(f"coalesce({c}, '') {c}" for c in CANDLE.split(", "))}, extra
from rows_in_file where nth > 0 or present""",
    "zip_csv_scan": _archived(),
    "archive_fetch_status": f"""{_with(GRID, RAW)},
found as (select distinct symbol, "date" from raw_candles where not {LEFT_OUT}),
every as (
 select symbol, "date", if(found."date" is null, 'ABSENT', 'FETCHED') status
 from grid left join found using (symbol, "date")
 union all select 'BROKENUSDT', "date", 'ERROR' from spine
 union all select 'NOSUCHUSDT', "date", 'ABSENT' from spine)
select symbol, '15m' "interval", "date", 'klines' source, status from every""",
    # an empty field and a missing one are the same in CSV
    "csv_scan_header_discard": f"""{RAW}
select {KEY}, {_POSITION} row_pos,
 {", ".join(f"nullif({c}, '') {c}" for c in TEXT.split(", "))} from raw_candles""",
    "landed_csv_normalize": CANDLES,
    "date_spine": f'{GRID} select "date" from spine',
    "job_grid": f"{GRID} select {KEY} from grid",
    "archive_path_interval": f"""{GRID} select {KEY},
 'archive/daily/' || source || '/' || symbol || '/' || "interval" || '/'
 || symbol || '-' || "interval" || '-' || "date" || '.zip' path from grid""",
    "archive_path_plain": f"""{GRID} select source, symbol, "date",
 'archive/daily/' || source || '/' || symbol || '/'
 || symbol || '-' || source || '-' || "date" || '.zip' path from grid""",
    "object_key": f"""{GRID} select {KEY},
 'raw/' || source || '/symbol=' || symbol || '/interval=' || "interval" || '/date=' || "date"
 || '/data.parquet' "key",
 source || '/symbol=' || symbol || '/interval=None/date=' || "date"
 || '/data.parquet' key_without_interval from grid""",
    "skip_empty_days": f"""{_with(GRID_AND_UNKNOWN, RAW)}
select {KEY} from wide_grid g where not exists (
 select 1 from raw_candles c
 where c.symbol = g.symbol and c."date" = g."date" and {PRESENT})""",
    "run_manifest": f"""{_with(GRID_AND_UNKNOWN, RAW)}, {DAY_STATS}
select {KEY},
 case when problem is not null then 'ERROR' when n_rows is null then 'SKIP' else 'DONE' end status,
 problem error, coalesce(n_rows, 0) n_rows,
 case when problem is null and n_rows > 0 then
  '/raw/' || source || '/symbol=' || symbol || '/interval=' || "interval" || '/date=' || "date"
  end path
from wide_grid left join typed_stats using ({KEY})""",
    "sink_day_isolation": f"""{_with(GRID, TYPED)}, {DAY_STATS},
stored as (select symbol, "date", count(*) n_stored from candles where symbol <> 'CLICKUSDT' group by all),
told as (
 select {KEY}, coalesce(n_rows, 0) n_rows, coalesce(n_stored, 0) n_stored,
  case when problem is not null then 'ERROR' when n_rows is null then 'SKIP'
       when symbol = 'CLICKUSDT' then 'ERROR' else 'DONE' end status
 from grid left join typed_stats using ({KEY}) left join stored using (symbol, "date"))
select {KEY}, status, n_rows, n_stored, status = 'DONE' has_folder from told""",
    "na_tokens_to_null": f"{RAW} select {KEY}, row_pos, {_NA_TO_NULL} from raw_candles",
    "drop_all_null_rows": f"{RAW} select {KEY}, row_pos, {TEXT} from raw_candles where {PRESENT}",
    "positional_project": f"{RAW} select {KEY}, row_pos, {CANDLE} from raw_candles",
    "coerce_float32": f"{RAW} select {KEY}, row_pos, {FLOATS} from raw_candles",
    "coerce_int64": f"{RAW} select {KEY}, row_pos, {INTS} from raw_candles",
    "day_gate": f"{TYPED} select {KEY}, row_pos, {CANDLE} from gated",
    "epoch_ms_to_utc": f"""{TYPED}
select {KEY}, row_pos, open_time, epoch_ms(open_time) "timestamp" from gated""",
    "drop_null_timestamp": f"""{TYPED}
select {KEY}, row_pos, open_time, epoch_ms(open_time) "timestamp" from gated
where not ({_NO_TIME})""",
    "dedup_keep_first": f"""{TYPED}
select {KEY}, row_pos, open_time, "open", "close", trades from candles""",
    "sort_open_time": f"""{TYPED}
select {KEY}, open_time, row_number() over (partition by {KEY} order by open_time) "position"
from candles""",
}
