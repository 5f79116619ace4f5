"""The shared folder: a temporary one on one machine, an error on a cluster that names none."""

import pytest

from marquee.session import shared_dir


class Conf(dict):
    def set(self, key, value):
        raise AssertionError(f"{key} is fixed once a session runs")


class Context:
    def __init__(self, settings):
        self.settings, self.folder = settings, None

    def getConf(self):
        return self.settings

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, **settings):
        self.conf = Conf()
        self.sparkContext = Context({k.replace("_", "."): v for k, v in settings.items()})


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(spark_master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(spark_master="local-cluster[2,1,1024]"))


def test_a_named_folder_is_used(tmp_path):
    session = Session(spark_master="yarn", spark_checkpoint_dir=str(tmp_path))
    assert shared_dir(session) == str(tmp_path) == session.sparkContext.folder


def test_one_machine_gets_a_temporary_folder():
    session = Session(spark_master="local[4]")
    assert shared_dir(session) == session.sparkContext.folder
    assert shared_dir(session) == shared_dir(session)
