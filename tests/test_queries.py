"""Queries against their SQL on the supplied tables."""

import duckdb
import pytest
from pyspark.sql.types import StructType

import __spark_entry__
from dayloom.operators import blocks, rollup
from dayloom.plans import feeds, registry
from dayloom.plans.chain import Chain

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "blocks block_bounds match_keys resolve_project resolve_subject nearest_anchor nearest_touch stretches manual_override attention_overlap runs claimed_pauses project_rows subject_rows day_totals range_totals unmatched fold_by_host scan_agent_log visit_to_trace domain_ignore reflog_collapse ical_times meeting_filter expand_recurrence replace_window export_rows dead_rules snapshot_read stream_dedup stream_ingest stream_counts stream_blocks stream_touched_days long_background run_evidence incremental_scan append_dedup project_candidates domain_ignore_entries day_document".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    sql = registry.ORACLE_SQL[name]
    assert sorted(duck.sql(sql).columns) == cols
    expected = sorted(repr(tuple(r)) for r in duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == expected


def test_touched_days_work_the_account_out_once_a_batch_on_few_columns(spark, monkeypatch):
    seen, attributed = [], blocks.attributed
    monkeypatch.setattr(blocks, "attributed", lambda named, hot=None: seen.append(named.columns) or attributed(named, hot))
    got = feeds.touched(Chain(spark, SF)).drop("disturbed")
    assert [set(c) for c in seen] == [set(feeds.NAMED)] * 2
    full = Chain(spark, SF).rows
    assert [(f.name, f.dataType) for f in full.schema] == [(f.name, f.dataType) for f in StructType.fromDDL(rollup.PROJECT_ROWS)]
    assert full.count() > 0 and full.exceptAll(got).count() == 0 and got.exceptAll(full).count() == 0


def test_every_sql_runs_and_has_a_query(duck):
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    for sql in registry.ORACLE_SQL.values():
        duck.sql(f"select count(*) from ({sql})").fetchall()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
