"""The index of identities against a plain join, and what of it is read."""

import re

import pytest
from pyspark.sql import functions as F

from praxilog.plans import identities


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("index")
    for k, (low, high) in enumerate(((0, 3000), (3000, 3050))):
        identities.write(made(spark, low, high), f"{place}/v{k}/index")
    return [f"{place}/v{k}/index" for k in range(2)]


def made(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("identity"), F.concat(F.lit("c"), "id").alias("content_hash"))


@pytest.mark.parametrize(("low", "high"), [(0, 5), (2990, 3010), (2900, 6000), (9000, 9100), (5, 5)])
def test_lookup_is_the_join(spark, folders, monkeypatch, low, high):
    wanted = made(spark, low, high)
    want = sorted((r[0], r[1]) for r in made(spark, 0, 3050).join(wanted.select("identity"), "identity", "left_semi").collect())
    assert sorted(map(tuple, identities.lookup(spark, folders, wanted).collect())) == want
    monkeypatch.setattr(identities, "FEW", -1)
    assert sorted(map(tuple, identities.lookup(spark, folders, wanted.union(wanted)).collect())) == want


def test_filters_hold_all_and_pass_few_others(spark, folders):
    assert identities.may_hold(spark, folders, made(spark, 0, 3050)).count() == 3050
    assert identities.may_hold(spark, folders, made(spark, 10_000, 14_000)).count() < 160


def test_only_touched_folders_are_read(spark, folders):
    wanted = made(spark, 7, 9).union(made(spark, 50_000, 50_020))
    plan = identities.lookup(spark, folders, wanted)._jdf.queryExecution().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    named = set(re.findall(r"\bb[0-9a-f]{2}\b", " ".join(filters)))
    touched = {r[0] for r in made(spark, 7, 9).select(identities.bucket(F.col("identity"))).collect()}
    assert len(filters) >= 2 and touched <= named and len(named) <= 4




def test_no_versions_and_null_identities(spark, folders):
    assert identities.lookup(spark, [], made(spark, 0, 3)).count() == 0
    assert identities.lookup(spark, folders, spark.createDataFrame([(None,)], "identity string")).count() == 0
