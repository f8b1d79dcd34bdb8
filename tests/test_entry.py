import sys

import __spark_entry__
from cragline.sources import scratch


def test_core_queries_stay_without_the_subpackage(monkeypatch):
    # modules that other tests have imported would not be imported again
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("cragline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)  # a module that the subpackage needs
    core = __spark_entry__.queries()
    assert core and not any(k.startswith("op") and k[2:3].isdigit() for k in core) and "pipeline" not in core
    assert set(__spark_entry__.oracle_sql()) <= set(core)


def test_intermediate_tables_are_read_back_and_deleted(spark):
    rows = spark.range(5)
    kept = scratch.cut(rows)
    assert kept.count() == 5 and scratch.scratch_dir(spark).startswith("file:///")
    store, at = scratch._at(spark, kept._scratch)
    assert store.exists(at)
    scratch.discard(kept, None, rows)
    assert not store.exists(at)
