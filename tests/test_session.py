"""Checkpoint / scratch locations come from the session's spark.checkpoint.dir."""

from opsdesk.session import checkpoint_dir, ensure_checkpoint_dir, scratch_path


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured
    assert ensure_checkpoint_dir(spark) == configured == checkpoint_dir(spark)
    assert scratch_path(spark, "x").startswith(configured.rstrip("/"))
    assert spark.sparkContext.getCheckpointDir() is not None


def test_cluster_without_a_shared_folder_is_an_error():
    """Off local mode nothing is ever written to a folder of the driver's machine."""
    import types

    import pytest

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)
    context = types.SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(types.SimpleNamespace(conf=Conf(), sparkContext=context))
