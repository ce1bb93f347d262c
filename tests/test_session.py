"""The scratch folder: read from the session, refused on a cluster that names none."""

import pytest

from tuneshelf.session import ensure_checkpoint_dir, is_local_master


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):  # noqa: N802
        return None

    def getConf(self):  # noqa: N802
        return _Conf()


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_cluster_without_shared_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session(master))


def test_local_masters():
    assert is_local_master("local") and is_local_master("local[8]") and is_local_master("local[*]")
    assert not is_local_master("local-cluster[3,2,1024]")
