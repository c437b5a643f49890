from types import SimpleNamespace

import pytest

from palimpsest import folders


def session(master, root=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: root), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            folders.shared_dir(session(master))
        assert folders.shared_dir(session(master, "hdfs://x/y/")).startswith("hdfs://x/y/palimpsest-")
    assert folders.shared_dir(session("local[4]")).startswith("file:///")
