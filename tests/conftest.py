import os

import pytest

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestack.session import local_session, ship

    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(session)
    yield session
    session.stop()


def frame(spark, schema: str, *rows):
    return spark.createDataFrame(list(rows), schema)
