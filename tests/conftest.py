import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    # Small inputs, many plans: few partitions and no code generation keep the tests short.
    # The comparison tool and the bench run with the settings of a real session.
    started = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    started.sparkContext.setLogLevel("ERROR")
    yield started
    started.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
