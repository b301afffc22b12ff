"""Where files of a job go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from ledgerloom.plans import workspace


def session(master, shared=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: shared if shared else default),
                           sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_only_one_process_may_use_a_folder_of_its_machine():
    for master in ("local", "local[8]", "local[*]"):
        assert "ledgerloom" in workspace.run_folder(session(master), "x")
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            workspace.run_folder(session(master), "x")
        with pytest.raises(ValueError):
            workspace.checkpointed(SimpleNamespace(sparkSession=session(master)))
        assert workspace.run_folder(session(master, "hdfs:///shared/"), "x").startswith("hdfs:///shared/ledgerloom/x-")
