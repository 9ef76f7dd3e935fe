"""Text to number to timestamp, as built-in expressions on a column given by name.

Spark's own cast is close to what is wanted but not equal to it: it raises on junk, reads
Java spellings such as ``1.5d`` or ``0x1p3`` as numbers, keeps NaN apart from null, and
saturates integers that overflow. The expressions are SQL text, as token lists built from
column objects take longer to plan than to run.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallow.schema import MAX_EPOCH_MS, MIN_EPOCH_MS, NA_TOKENS

_NA_LIST = ", ".join(f"'{token}'" for token in NA_TOKENS)

# Number spellings only Java knows: a type suffix (d, or f not in "inf"), or hex.
_JAVA_ONLY = r"rlike r'[dDxX]|[^nN][fF]\s*$'"


def _present(c: str) -> str:
    """True for a value; false or null for a missing one, which a filter takes alike."""
    return f"`{c}` not in ({_NA_LIST})"


def any_present(columns: list[str]) -> Column:
    """Short-circuits: on ordinary rows only the first column is looked at."""
    return F.expr(" or ".join(map(_present, columns)))


def na_to_null(c: str) -> Column:
    return F.expr(f"case when {_present(c)} then `{c}` end")


def may_be_java(columns: list[str]) -> Column:
    """Whether any of the texts holds a letter that Java-only number spellings have.

    Asked once per row, it keeps the pattern off all but a few rows, and the code of a
    stage short enough for the JVM to compile.
    """
    row = F.lower(F.concat_ws(" ", *columns))
    return row.contains("d") | row.contains("f") | row.contains("x")


def to_float32(c: str, suspect: str = "true") -> Column:
    """Parse as double, then narrow; junk and NaN become null, overflow infinity.

    Missing-value tokens are sorted out before the cast, in which a failure is slow.
    ``suspect`` names the row's ``may_be_java``.
    """
    java = f"({suspect} and `{c}` {_JAVA_ONLY})"
    number = f"case when {_present(c)} and not {java} then try_cast(`{c}` as double) end"
    return F.expr(f"nanvl(cast({number} as float), cast(null as float))")


def to_int64(c: str) -> Column:
    """Integers exactly, other numbers cut off at the point; null if neither fits.

    A double of 2^63 is cast to the largest integer; adding one makes that case overflow
    to null, and no other double comes near it.
    """
    number = f"case when not `{c}` {_JAVA_ONLY} then try_cast(`{c}` as double) end"
    cut_off = f"try_add(try_cast({number} as bigint), 1L) - 1L"
    return F.expr(f"coalesce(try_cast(`{c}` as bigint), {cut_off})")


def epoch_ms_in_range(ms: str) -> Column:
    return F.col(ms).between(MIN_EPOCH_MS, MAX_EPOCH_MS)


def epoch_ms_to_utc(ms: str) -> Column:
    """Timestamp of an epoch in milliseconds; null outside the nanosecond range."""
    return F.when(epoch_ms_in_range(ms), F.timestamp_millis(F.col(ms)))
