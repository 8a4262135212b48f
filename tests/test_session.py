"""The shared folder, written tables and kept ones."""

import os

import pytest

from moltide import session as SE


def test_only_local_masters_go_without_a_folder():
    assert SE.is_local("local") and SE.is_local("local[4]") and SE.is_local("local[*]")
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        assert not SE.is_local(master)

    class Other:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        SE.shared_dir(Other)


def test_written_tables_are_removed(spark):
    t = SE.written(spark.range(5), "five")
    folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and t.count() == 5
    SE.drop_written(t)
    assert not os.path.exists(folder)


def test_kept_table_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert SE.cached(spark, str(tmp_path / "kept"), make).count() == 3
    assert len(made) == 1
