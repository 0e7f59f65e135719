"""The checkpoint folder must be shared on a cluster."""

import pytest

from shopsight.session import checkpoint_root


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_without_folder_is_refused(master):
    with pytest.raises(ValueError):
        checkpoint_root(master, None)
    assert checkpoint_root(master, "hdfs:///shared") == "hdfs:///shared"


def test_local_master_gets_a_folder():
    assert checkpoint_root("local[4]", None) and checkpoint_root("local", None)
