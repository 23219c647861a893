import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from recollect.session import local_session, ship

    where = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, 4, **{"spark.checkpoint.dir": where, "spark.driver.memory": "4g"})
    ship(session)
    yield session
    session.stop()
