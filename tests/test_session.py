import os

import pytest

from tessella import session


def files(spark):
    path = session.shared_dir(spark).removeprefix("file://") + "/tessella"
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_materialized_tables_are_deleted(spark):
    before = files(spark)
    with session.temporary(spark):
        kept = session.materialize(spark.range(5), "one")
        with pytest.raises(ZeroDivisionError), session.temporary(spark):
            session.materialize(spark.range(2), "two")
            raise ZeroDivisionError
        assert kept.count() == 5 and {n.split("-")[0] for n in files(spark) - before} == {"one"}
    assert files(spark) == before
    session.materialize(spark.range(3), "old")
    assert session.clean_up(spark, older_than_hours=1) == 0 and len(files(spark) - before) == 1
    assert session.clean_up(spark, older_than_hours=-1) > 0 and files(spark) == set()


def test_a_cluster_must_name_its_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Cluster:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Cluster())
