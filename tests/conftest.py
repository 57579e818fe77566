import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cairn.session import session

    with tempfile.TemporaryDirectory() as folder:
        s = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.memory": "4g"})
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA
