from types import SimpleNamespace

import pytest

from bazaar.sources.workspace import new_folder, shared_folder


def session(master, folder=None, application="app-1"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=application),
    )


def test_the_cluster_names_the_folder():
    assert shared_folder(session("spark://host:7077", "hdfs://data/shared/")) == "hdfs://data/shared"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))


def test_one_temporary_folder_per_local_application():
    one = shared_folder(session("local[2]"))
    assert one == shared_folder(session("local[2]")) != shared_folder(session("local[2]", application="app-2"))


def test_new_folders_differ():
    local = session("local[2]", "/shared")
    assert new_folder(local, "x") != new_folder(local, "x")
    assert new_folder(local, "x").startswith("/shared/bazaar/app-1/x-")


def test_a_closed_warehouse_leaves_nothing(spark, tmp_path):
    from bazaar.plans.warehouse import Warehouse

    warehouse = Warehouse(spark, {}, str(tmp_path / "tables"))
    assert warehouse.table("numbers", lambda: spark.range(5)).count() == 5
    warehouse.close()
    assert not (tmp_path / "tables").exists() and not warehouse.written("numbers")
    assert warehouse.table("numbers", lambda: spark.range(6)).count() == 6
