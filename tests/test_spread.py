import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators.corpus import Corpus
from lodestar.operators.rules import StdInNoStdCrate
from lodestar.plans import registry, synth

SF = "/root/testdata/sf0.1"


def test_a_small_table_of_many_files_is_spread(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    for name in ("parts", "old", "new", "orders"):
        assert synth.FILES[name](spark, SF).rdd.getNumPartitions() >= 4, name
    rows = spark.range(synth.TASK_FILES * 9)
    spread = synth.spread(rows, "id", synth.TASK_FILES * 9)
    assert spread.rdd.getNumPartitions() == 9
    most = spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < synth.TASK_FILES * 1.1


def test_a_query_parses_only_what_it_reads(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    registry.QUERIES["calls_contains"](spark, SF)
    facts = synth.corpus(spark, SF, "orders", relations=["calls"]).facts
    assert "calls" in facts.columns and "paths" not in facts.columns


def test_the_no_std_flag_is_no_broadcast(spark, capsys):
    files = spark.createDataFrame([("a.rs", None, 0, "#![no_std]\nuse std::io;"), ("b.rs", None, 1, "fn f() { std::fs::read(x) }")], "path string, modified timestamp, file_ord long, source string")
    corpus = Corpus.from_sources(files, "k")
    found = corpus.rules().add_rule(StdInNoStdCrate()).run()
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert sorted(r["message"] for r in found.collect()) == ["std import in no_std crate: std::io", "std path in no_std crate: std::fs::read"]
    with_std = Corpus.from_sources(files.where("file_ord = 1"), "k")
    assert with_std.rules().add_rule(StdInNoStdCrate()).run().count() == 0


def test_the_imports_of_few_files_are_few_tasks(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in the plan of a kept corpus
    try:
        files = synth.imports_files(spark, SF)
        assert files.count() == 25 and files.rdd.getNumPartitions() <= 25
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
