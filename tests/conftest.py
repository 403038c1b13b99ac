import pytest
from pyspark.sql import SparkSession

from tideworks.session import SETTINGS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    more = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=SETTINGS | more).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
