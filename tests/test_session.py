from casefile.session import _SHIPPED, checkpoint_dir, get_session, ship_package


def test_defaults_and_checkpoint_folder(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.ui.enabled") == "false"
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("1m", "1048576", "1048576b")
    folder = checkpoint_dir(spark)
    assert folder.rstrip("/").endswith("ckpt")  # the configured folder wins
    assert spark.sparkContext.getCheckpointDir()


def test_package_shipped_once(spark):
    before = len(_SHIPPED)
    ship_package(spark)
    ship_package(spark)
    assert len(_SHIPPED) == before  # already shipped by get_session
    assert get_session() is spark


class _FakeConf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _FakeContext:
    def __init__(self, master, values):
        self.master = master
        self._conf = _FakeConf(values)

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.set_to = path


class _FakeSession:
    def __init__(self, master, values=None):
        self.conf = _FakeConf(values or {})
        self.sparkContext = _FakeContext(master, values or {})


def test_cluster_without_shared_checkpoint_folder_fails():
    import pytest

    with pytest.raises(RuntimeError, match="shared storage"):
        checkpoint_dir(_FakeSession("yarn"))
    session = _FakeSession("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert checkpoint_dir(session) == "hdfs:///shared/ckpt"
    assert session.sparkContext.set_to == "hdfs:///shared/ckpt"
