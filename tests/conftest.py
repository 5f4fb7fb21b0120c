import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from splicework import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.build(
        "local[4]", "tests", **{
            "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt")),
        }
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def split(spark):
    """Make every key of more than two rows a heavy one, in segments of two."""
    names = {"smallBytes": "0", "heavyRows": "2", "heavySample": "1", "segmentRows": "2"}
    for k, v in names.items():
        spark.conf.set(f"spark.splicework.{k}", v)
    yield
    for k in names:
        spark.conf.unset(f"spark.splicework.{k}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
