"""Session rules: the checkpoint folder comes from the session."""

import pytest

from sightline.session import ensure_checkpoint_dir, fix, scratch_path


class _FakeContext:
    def __init__(self, master, current=None):
        self.master = master
        self._dir = current
        self.set_to = None

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self.set_to = d
        self._dir = d


class _FakeConf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _FakeSession:
    def __init__(self, master, conf_dir=None, current=None):
        self.sparkContext = _FakeContext(master, current)
        self.conf = _FakeConf(conf_dir)


def test_checkpoint_dir_from_session_conf():
    s = _FakeSession("yarn", conf_dir="hdfs://nn/shared/ckpt")
    assert ensure_checkpoint_dir(s) == "hdfs://nn/shared/ckpt"


def test_cluster_without_checkpoint_dir_fails():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_FakeSession("yarn"))


def test_local_without_checkpoint_dir_gets_scratch():
    s = _FakeSession("local[2]")
    assert ensure_checkpoint_dir(s)
    assert s.sparkContext.set_to is not None


def test_existing_dir_kept_and_fix_computes(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert scratch_path(spark, "x").endswith("/sightline/x")
    df = fix(spark.range(10).selectExpr("id * 2 AS v"))
    assert sorted(r.v for r in df.collect()) == list(range(0, 20, 2))
