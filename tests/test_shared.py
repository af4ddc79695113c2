"""Where shared tables go."""

import pytest

from courtside import shared


def test_a_machine_local_folder_serves_local_masters_only(spark):
    for master in ("local", "local[8]", "local[*]"):
        shared._require_local(master)
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared._require_local(master)
    assert shared.fresh_path(spark, "x") != shared.fresh_path(spark, "x")
