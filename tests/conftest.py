import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from clickfeat.session import get_spark
    s = get_spark("local[4]", 8, app_name="clickfeat-tests",
                  extra={"spark.driver.memory": "8g",
                         "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="clickfeat-wh-")})
    yield s
    s.stop()
