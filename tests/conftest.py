import pytest

from strata.session import build

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(
        "strata-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__sql__maxMetadataStringLength="2000",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__streaming__stopTimeout="60s",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def entities(spark, sf_dir):
    from strata.plans.entities import Entities

    return Entities(spark, sf_dir)
