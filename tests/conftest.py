import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    spark = session(4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
