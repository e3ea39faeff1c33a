"""Session helpers: partition sizing from input size, checkpoint directory."""

from pressferry import session


def test_size_shuffle_partitions_from_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffle_partitions(spark, 10 * 1024**3) == 200  # floor
        assert session.size_shuffle_partitions(spark, 100 * 1024**4) == 409600
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "409600"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")


def test_input_bytes_and_checkpoint_dir(spark):
    assert session.input_bytes(spark, ["/root/testdata/sf0.001"]) > 0
    assert session.input_bytes(spark, ["/root/testdata/no-such-dir"]) == 0
    assert session.ensure_checkpoint_dir(spark)


def test_cluster_profile_keeps_checkpoint_dir_to_the_cluster():
    assert "spark.checkpoint.dir" not in session.CLUSTER_LAUNCH_CONF
    assert session.CLUSTER_LAUNCH_CONF["spark.decommission.enabled"] == "true"
