"""Where intermediate tables go."""

import pytest

from depthframe.sources.shared import scratch


class Session:
    """What scratch asks of a session: its settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, key, default):
        return self.settings.get(key.replace(".", "_"), default)


def test_setting_counts():
    assert scratch(Session(spark_checkpoint_dir="hdfs://x/shared", spark_master="yarn")) == "hdfs://x/shared"


def test_no_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session(spark_master="spark://somewhere:7077"))
    local = Session(spark_master="local[2]", spark_app_id="a")
    assert scratch(local).startswith("file:///") and scratch(local) == scratch(local)
