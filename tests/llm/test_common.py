import pyarrow as pa
import pytest

from voltwarden.llm import common


def test_written_and_clear(spark):
    df = common.written(spark.range(5).withColumnRenamed("id", "n"), "numbers")
    assert sorted(r.n for r in df.collect()) == [0, 1, 2, 3, 4]
    (path,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    assert path.startswith(common.shared_dir(spark))
    common.clear(spark)
    assert common.written(spark.range(0), "numbers").count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "__body int, ___BODY int")
    assert common.fresh(df, "body", "body") == ["____body", "_____body"]


def test_session_is_set_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(key), []
    df = spark.range(0, 5000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    sizes = [r.n for r in common.written(df, "sizes").collect()]
    assert sum(sizes) == 5000 and max(sizes) <= common.BATCH_ROWS and spark.conf.get(key) == before


def test_scopes(spark):
    with common.scope(spark):
        gone = common.written(spark.range(3), "gone")
        with common.scope(spark):
            kept = common.written(spark.range(4), "kept", keep=True)
            inner = common.written(spark.range(5), "inner")
        assert kept.count() == 4 and gone.count() == 3
        with pytest.raises(Exception, match="(?i)not.?exist|no such"):
            spark.read.parquet(inner.inputFiles()[0]).count()
    for df in (gone, kept):
        with pytest.raises(Exception, match="(?i)not.?exist|no such"):
            spark.read.parquet(df.inputFiles()[0]).count()


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context

    with pytest.raises(ValueError):
        common.shared_dir(Session)
