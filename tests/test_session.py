from tesselon.session import cut_lineage, drop_tables, shared_dir, store_table


def test_tables_lie_in_the_folder_of_the_session(spark):
    df = store_table(spark.range(5).selectExpr("id", "cast(null as string) as n"))
    assert df.count() == 5 and df.schema["n"].dataType.simpleString() == "string"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir") and shared_dir(spark) in df.inputFiles()[0]
    assert cut_lineage(spark.range(3)).count() == 3
    drop_tables(spark)
    assert store_table(spark.range(2)).count() == 2


def test_shuffle_files_go_once_a_table_is_stored(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    before = shuffled()
    stored = store_table(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count())
    assert not shuffled() - before and stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
