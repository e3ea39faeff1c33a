import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pressferry.session import SCALE_DEFAULTS, ensure_checkpoint_dir

    builder = (SparkSession.builder.master("local[*]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.ansi.enabled", "true"))
    for k, v in SCALE_DEFAULTS.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="pressferry-test-")


SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("PRESSFERRY_ORACLE_SF", "/root/testdata/sf0.001")
