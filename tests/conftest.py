import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package from here.
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from scoreweave.session import local_session

    with tempfile.TemporaryDirectory() as folder:
        session = local_session(4, 4, **{"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"})
        yield session
        session.stop()
