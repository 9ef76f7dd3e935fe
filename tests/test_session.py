"""Where intermediate data goes."""

import pytest

from tallow.session import shared_path


class Session:
    """The settings of a session, without one."""

    def __init__(self, **settings):
        self.settings, self.conf = settings, self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x", ""])
def test_no_folder_of_one_machine_on_several(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session(**{"spark.master": master}), "x")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]", "local[4,2]"])
def test_one_machine_may_do_without(master):
    session = Session(**{"spark.master": master})
    first, second = shared_path(session, "x"), shared_path(session, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_the_clusters_folder_is_used():
    session = Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_path(session, "x").startswith("hdfs:///shared/tallow-x-")
