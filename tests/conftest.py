import pytest
from pyspark.sql import SparkSession

from racelake.session import configured


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        configured(SparkSession.builder.master("local[4]"))
        .appName("racelake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
