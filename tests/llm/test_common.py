"""Intermediate tables, and what tasks are given."""

import os
from types import SimpleNamespace

import pytest

from leafmill.llm import common
from leafmill.sources import shared


def folders(spark):
    place = f"{shared.shared_dir(spark)}/leafmill".removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_tables_go_with_their_scratch(spark):
    before = folders(spark)
    with common.scratch(spark):
        one = common.saved(spark, spark.range(5), "one")
        with common.scratch(spark):
            two = common.kept(common.saved(spark, spark.range(6), "two"))
            common.saved(spark, spark.range(7), "three")
        assert two.count() == 6 and one.count() == 5 and len(folders(spark) - before) == 2
        four = common.kept(common.saved(spark, spark.range(8), "four"))
    assert len(folders(spark) - before) == 1 and four.count() == 8
    common.discard(spark, four)
    assert folders(spark) == before


def test_near_duplicates_leave_little(spark):
    from leafmill.llm import near

    before = folders(spark)
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(8)], "doc_id long, text string")
    near.near_duplicates(spark, docs).count()
    left = {f.rsplit("-", 1)[0] for f in folders(spark) - before}
    assert left <= {"near-signed", "near-classes", "near-rest", "links"}


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(cluster)
    assert not shared.is_local(cluster) and not shared.is_local(SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))


def test_the_package_is_sent_to_a_cluster(spark, monkeypatch):
    import zipfile

    sent = []
    context = SimpleNamespace(master="spark://host:7077", applicationId="app-test", addPyFile=lambda path: sent.append(sorted(zipfile.ZipFile(path).namelist())))
    for _ in range(2):
        common.ship(SimpleNamespace(sparkContext=context, conf=spark.conf))
    assert len(sent) == 1 and "leafmill/llm/near.py" in sent[0] and "leafmill/__init__.py" in sent[0]
