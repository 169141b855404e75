"""Shared checkpoint folder and staging modes."""
from casebook.plans.stage import materialise, stage
from casebook.session import checkpoint_dir, is_local


def test_checkpoint_dir_is_registered_and_reused(spark):
    d1 = checkpoint_dir(spark)
    assert d1 and spark.sparkContext.getCheckpointDir() is not None
    assert checkpoint_dir(spark) == d1          # the session's setting wins, never replaced


def test_stage_modes_keep_results(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    want = sorted(tuple(r) for r in df.collect())
    cut = materialise(df)                        # lineage cut into the shared folder
    assert checkpoint_dir(spark).split(":")[-1].lstrip("/") in cut.inputFiles()[0]
    assert sorted(tuple(r) for r in cut.collect()) == want
    held = stage(df)
    assert sorted(tuple(r) for r in held.collect()) == want
    held.unpersist()


def test_only_single_process_masters_are_local():
    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[3,2,1024]") and not is_local("yarn")
