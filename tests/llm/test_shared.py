"""The helpers that operators share."""

import os
import tempfile
import time

from evidora.llm import shared


def shuffle_files():
    top = tempfile.gettempdir()
    return {f for d in os.listdir(top) if d.startswith("blockmgr-") for _, _, names in os.walk(f"{top}/{d}") for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_cut_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    setting = spark.conf.get(shared.CLEANUP, "false")
    before = shuffle_files()
    df = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(3, "id").groupBy("k").count()
    out = shared.cut(df)
    until = time.time() + 20  # executors delete when they get to it
    while (left := shuffle_files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(shared.CLEANUP, "false") == setting
    assert sorted(map(tuple, out.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert shared.cut(df).count() == 7  # the plan can run again
