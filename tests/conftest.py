import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_all(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


TRIPLE = (
    "input string, output string, output_concept string, category string, ord long"
)


@pytest.fixture
def triples(spark):
    """Builds a triple table; the order is that of the list."""

    def build(*rows):
        data = [(*row, number) for number, row in enumerate(rows)]
        return spark.createDataFrame(data, TRIPLE)

    return build


@pytest.fixture
def one(spark):
    """Value of an expression, or of what a function returns, over one row of strings."""

    def value(expression, **columns):
        schema = ", ".join(f"{c} string" for c in columns) or "dummy string"
        row = tuple(columns.values()) or (None,)
        column = expression() if callable(expression) else expression
        return spark.createDataFrame([row], schema).select(column.alias("v")).first().v

    return value


@pytest.fixture
def rows_read(spark):
    """Rows that scans have delivered while a function ran, from Spark's own stage metrics."""

    def stages():
        context = spark.sparkContext
        store = context._jsc.sc().statusStore()
        no_quantiles = context._gateway.new_array(context._jvm.double, 0)
        every = context._jvm.java.util.ArrayList()
        found = store.stageList(None, False, False, no_quantiles, every)
        listed = [found.apply(i) for i in range(found.size())]
        return {(s.stageId(), s.attemptId()): s.inputRecords() for s in listed}

    def measure(run):
        before = stages()
        run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(n for key, n in stages().items() if key not in before)

    return measure
