import pytest

from stratum.llm.storage import clean, saved


def test_saved_tables_and_cleaning(spark):
    clean(spark)
    a = saved(spark.range(10), "a")
    assert a.columns == ["id"] and sorted(r.id for r in a.collect()) == list(range(10))
    assert saved(spark.range(0), "b").count() == 0
    assert clean(spark) == 2 and clean(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|path"):
        a.collect()


def test_shuffle_files_go_with_the_write(spark):
    """Blocks of a shuffle are gone once the table is written; the setting is as before."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    sc = spark.sparkContext
    blocks = lambda: {str(b) for b in sc._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n") if "shuffle_" in str(b)}
    held = blocks()
    df = spark.range(100_000, numPartitions=4).selectExpr("id", "xxhash64(id) as k").groupBy("k").count()
    done = saved(df, "grouped")
    assert not blocks() - held
    assert done.count() == 100_000 and spark.conf.get(setting) == before
    clean(spark)
