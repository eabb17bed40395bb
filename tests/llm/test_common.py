"""The folder of checkpoints."""

import types

import pytest

pytest.importorskip("driftline.llm")

from driftline.llm.common import cut  # noqa: E402


def test_a_cluster_without_a_shared_folder_is_refused():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="share"):
        cut(types.SimpleNamespace(sparkSession=session))
