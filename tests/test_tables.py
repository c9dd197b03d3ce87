import os
import time

import pytest
from pyspark.sql import functions as F

from lexisift.tables import SHUFFLES_GO, chosen_folder, once, shared_folder


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local[4,2]"])
def test_one_process_may_use_a_folder_of_its_machine(master):
    assert "lexisift-" in chosen_folder(master, None, "file:/x/spark-warehouse")
    assert chosen_folder(master, "file:/shared", None) == "file:/shared"


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://https://host"])
def test_a_cluster_may_not(master):
    for warehouse in (None, "file:/x/spark-warehouse", "/x/spark-warehouse"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            chosen_folder(master, None, warehouse)
    assert chosen_folder(master, "hdfs://n/c", "file:/x") == "hdfs://n/c"
    assert chosen_folder(master, None, "hdfs://n/warehouse/") == "hdfs://n/warehouse/_checkpoints"


def test_the_folder_stays(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_what_was_shuffled_for_rows_worked_out_once_goes_at_once(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {x.split("_")[1] for d in top for _, _, names in os.walk(d) for x in names if x.startswith("shuffle_")}
    before, setting = shuffles(), spark.conf.get(SHUFFLES_GO, None)
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    rows = once(frame)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(SHUFFLES_GO, None) == setting
    assert rows.collect() and sorted(rows.collect()) == sorted(rows.join(frame, ["k", "count"]).collect()) == sorted(frame.collect())
    frame.collect()  # another's own frame keeps what it shuffled, and may be read again
    assert shuffles() - before
