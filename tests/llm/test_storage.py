"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from pagesieve.llm.storage import shared_folder


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder(session("spark://host:7077", "s3a://bucket/shared/")) == "s3a://bucket/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


def test_one_process_falls_back_to_a_temporary_folder():
    assert shared_folder(session("local[8]")) == shared_folder(session("local"))
