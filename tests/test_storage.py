import pytest

from listprep import storage


@pytest.fixture
def unset(monkeypatch):
    monkeypatch.setattr(storage, "SETTING", "spark.checkpoint.dir.not.set")
    monkeypatch.setattr(storage, "_own_folders", {})


def test_without_the_setting_a_local_session_has_a_folder_of_its_own(spark, unset):
    table = storage.materialise(spark.range(3), "x")
    assert table.count() == 3
    assert storage.working_dir(spark) == storage.working_dir(spark)
    storage.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(storage.application_dir(spark)).count()


@pytest.mark.parametrize(
    "folder,default,local",
    [
        ("file:///tmp/x", "hdfs", True), ("file:/var/tmp", "hdfs", True), ("file:///shared/x", "file", False), ("hdfs://n/tmp", "file", False),
        ("/tmp/checkpoints", "file", True), ("/tmp/checkpoints", "hdfs", False), ("file:/local_disk0/x", "s3a", True),
    ],
)
def test_folders_of_one_machine(folder, default, local):
    assert storage._machine_local(folder, default) == local


def test_paths_without_scheme_are_those_of_the_default_file_system(spark):
    assert storage._default_scheme(spark) == "file"
