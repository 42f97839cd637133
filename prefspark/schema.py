"""Table shapes shared by the readers, operators and writers."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

CONVERSATION = T.ArrayType(MESSAGE)

PAIR_COLUMNS = ("prompt", "chosen", "rejected")

PAIR = T.StructType([T.StructField(name, CONVERSATION) for name in PAIR_COLUMNS])

# Columns a triple table must have; the last two only where flow A filters on them.
TRIPLE_COLUMNS = ("input", "output", "output_concept", "category")
FILTERED_TRIPLE_COLUMNS = TRIPLE_COLUMNS + ("concept_genre", "concept_id")

METRIC_RECORD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("experiment", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("checkpoint", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("rendered_prompt", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("checkpoint", T.StringType()),
        T.StructField("loaded_model", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("samples", T.ArrayType(SAMPLE)),
    ]
)


def missing_columns(df, columns):
    """Those of ``columns`` that ``df`` lacks, in their order."""
    return [name for name in columns if name not in df.columns]


def require_columns(df, columns, what="table"):
    """Fail before any job when ``df`` lacks one of ``columns``; name every one missing."""
    missing = missing_columns(df, columns)
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def free_names(columns, *names):
    """The names, each with as many underscores in front as keep it apart from ``columns``.

    For columns that an operator adds for a while: the user's own columns are never replaced.
    Spark tells names apart without regard to case, and so does this.
    """
    taken, free = {name.lower() for name in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        free.append(name)
    return free
