import os

import pytest
from edge import edge_rows, write


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), edge_rows(), clash=True)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.001"
