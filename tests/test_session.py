"""The shared folder, with and without the setting that names it."""

import subprocess
import sys
from pathlib import Path

import pytest

from inkveil import session


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, master, **values):
        self.conf = Conf(values)
        self.sparkContext = type("Context", (), {"master": master})()


def test_folder_of_the_setting():
    spark = Session("spark://host:1", **{session.SHARED: "file:///shared/"})
    assert session.shared_dir(spark, "rows").startswith("file:///shared/rows-")


def test_local_sessions_share_one_folder():
    folders = {session.shared_dir(Session("local[3]"), "rows").rsplit("/", 1)[0] for _ in range(3)}
    assert len(folders) == 1


@pytest.mark.parametrize("master", ["yarn", "spark://host:1", "local-cluster[2,1,1024]"])
def test_clusters_need_the_setting(master):
    with pytest.raises(RuntimeError, match=session.SHARED):
        session.shared_dir(Session(master), "rows")


def test_plain_session_writes():
    """A session with nothing configured, in a process of its own."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from inkveil.session import written\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', written(spark.range(7), 'rows').count())\n"
    )
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert "rows 7" in done.stdout, done.stderr[-2000:]
