import pytest

from framelake import tables


class Settings(dict):
    @property
    def conf(self):
        return self


def test_shared_folder():
    assert tables.shared_path(Settings({"spark.checkpoint.dir": "hdfs://x/y/"}), "t").startswith("hdfs://x/y/t-")
    assert tables.shared_path(Settings({"spark.master": "local[2]"}), "t").startswith("/tmp/spark-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_path(Settings({"spark.master": "spark://host:7077"}), "t")


def test_written_tables_can_be_dropped(spark):
    t = tables.materialise(spark.range(5), "t")
    assert t.count() == 5
    tables.discard(t)
    with pytest.raises(Exception, match="(?i)not exist|not found|PATH_NOT_FOUND"):
        spark.read.parquet(t.table_path).count()
