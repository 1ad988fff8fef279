import pytest

from mathloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Run a column function over texts, in order."""
    from pyspark.sql import functions as F

    def run(function, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1)
        return [row.out for row in df.select("i", function(F.col("s")).alias("out")).orderBy("i").collect()]

    return run
