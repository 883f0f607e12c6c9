import pytest
from pyspark.sql import SparkSession

from gridengine.plans.workspace import Workspace

from gridengine.sources import workbooks as made


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sample_file(tmp_path_factory):
    return made.sample(tmp_path_factory.mktemp("sample") / "sample.xlsx")


@pytest.fixture(scope="session")
def sample(spark, sample_file):
    return Workspace.load(spark, sample_file)


@pytest.fixture(scope="session")
def zoom(spark, tmp_path_factory):
    return Workspace.load(spark, made.zoom(tmp_path_factory.mktemp("zoom") / "zoom.xlsx"))


@pytest.fixture(scope="session")
def three_files(tmp_path_factory):
    return made.collection(tmp_path_factory.mktemp("three"))


@pytest.fixture(scope="session")
def three(spark, three_files):
    return Workspace.load(spark, three_files)
