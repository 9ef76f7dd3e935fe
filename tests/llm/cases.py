"""Rows that every operator must bear."""

ODD_COLUMNS = (
    "record string, slot string, shard string, bucket string, score string, lang_pred string, "
    "fp string, piece string, _nth string, _row_key string"
)


def documents(spark, extra=(), odd=True):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 97} more{i % 89}" for i in range(20_000))
    rows = [
        (1, "the cat sat on the mat by the door", "en", "a"),
        (1, "the cat sat on the mat by the door", "en", "a"),
        (2, "the cat sat on the mat by the door", "en", None),
        (3, None, "en", "a"),
        (4, "", None, "a"),
        (5, "   \n\t ", "de", "a"),
        (None, "a text without an id", "fr", "a"),
        (None, None, None, None),
        (6, long, "en", "b"),
        (7, "x" * 5000, "en", "b"),
        (8, "12345 67890 !!! ...", "es", "b"),
        *extra,
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    if not odd:
        return df
    for name in ODD_COLUMNS.split(", "):
        df = df.selectExpr("*", f"'odd' as `{name.split()[0]}`")
    return df


def none(df):
    return df.where("1 = 0")
