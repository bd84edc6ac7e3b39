"""The shared scratch folder."""

from types import SimpleNamespace

import pytest

from verdance import session


def stub(master, folder=None, app="app-1"):
    """A session that refuses to change its settings, as Spark does."""

    def refused(*_):
        raise AssertionError("a running session's setting was changed")

    conf = SimpleNamespace(get=lambda key, default=None: default, set=refused)
    context = SimpleNamespace(
        master=master, applicationId=app, getConf=lambda: SimpleNamespace(get=lambda key, default=None: folder or default)
    )
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_named_folder_is_used():
    assert session.scratch_root(stub("spark://host:7077", "hdfs://store/shared")) == "hdfs://store/shared"
    assert session.scratch_path(stub("local[2]", "/shared/"), "x").startswith("/shared/verdance/x-")


def test_a_plain_local_session_has_one_folder():
    a, b = (session.scratch_root(stub("local[2]", app="app-2")) for _ in range(2))
    assert a == b != session.scratch_root(stub("local[2]", app="app-3"))


def test_a_cluster_must_name_one():
    with pytest.raises(RuntimeError, match="shared folder"):
        session.scratch_root(stub("yarn"))
