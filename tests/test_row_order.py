"""Row ids in file order, one row per new test id, partition counts and broadcast bounds."""
import tempfile

from clickfeat.operators.keyed import ROWS_PER_TASK, root_partitions
from clickfeat.operators.prep import with_file_order_ids
from clickfeat.operators.skew import KeyProfile, forced_profile
from clickfeat.operators.testmap import map_test_ids
from clickfeat.sources.clicks import read_clicks_train


def test_row_ids_follow_files_of_unequal_size(spark):
    tmp = tempfile.mkdtemp(prefix="clickfeat-order-")
    head = "ip,app,device,os,channel,click_time,attributed_time,is_attributed\n"
    n = 0
    for name, rows in (("a", 40), ("b", 2500), ("c", 1), ("d", 900)):
        with open(f"{tmp}/{name}.csv", "w") as f:
            f.write(head)
            for _ in range(rows):
                f.write(f"{n},1,1,1,1,2017-11-06 14:32:21,,0\n")
                n += 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        placed = read_clicks_train(spark, tmp, place=True)
        assert placed.rdd.getNumPartitions() > 117
        got = with_file_order_ids(placed, tempfile.mkdtemp(prefix="clickfeat-placed-"))
        assert "__file" not in got.columns
        assert sorted((r.row_id, r.ip) for r in got.select("row_id", "ip").collect()) == [(i, i) for i in range(n)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_new_id_has_one_row(spark):
    cols = "click_id long, ip int, app int, device int, os int, channel int, click_time string"
    test = spark.createDataFrame([(100, 1, 1, 1, 1, 1, "t"), (100, 9, 9, 9, 9, 9, "t"), (101, 9, 9, 9, 9, 9, "t")], cols)
    supp = spark.createDataFrame([(11, 1, 1, 1, 1, 1, "t"), (12, 1, 1, 1, 1, 1, "t")], cols)
    assert sorted((r[0], r[1]) for r in map_test_ids(test, supp).collect()) == [(100, 11), (101, None)]


def test_partitions_follow_the_rows():
    profile = KeyProfile(total_rows=1000 * ROWS_PER_TASK, distinct={"ip": 5}, max_group={"ip": 5}, min_second=0, max_second=9)
    assert root_partitions(200, profile) == 1000
    assert root_partitions(2000, profile) == 2000
    assert root_partitions(8, forced_profile("window")) == 8
