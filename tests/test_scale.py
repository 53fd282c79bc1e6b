"""What larger tables need: small tasks, thin shuffles, no shuffle files or spent messages left behind."""

import os

import pyarrow.parquet as pq
import pytest

from bazaar.contract import TABLES, to_snake
from bazaar.operators.dedup import keep_first
from bazaar.operators.fact import build_fact, fact_columns
from bazaar.plans import catalog
from bazaar.plans.warehouse import PASSES, Warehouse
from bazaar.sources import adapter
from bazaar.sources.files import exists
from bazaar.sources.sinks import ROW_GROUP_BYTES, write_fact, write_rows
from bazaar.sources.workspace import METHOD_BYTES, SHUFFLE_CLEANUP, TASK_INPUT, bounded_tasks, new_folder, shuffles_removed
from tests.conftest import SF_DIR


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


@pytest.mark.parametrize("write", [write_rows, write_fact])
def test_a_write_leaves_no_shuffle_files(spark, write):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    rows = spark.range(1000).selectExpr("id", "id % 3 as purchase_year", "id % 7 as purchase_month").repartition(5, "id")
    path = new_folder(spark, "rows")
    write(rows, path)
    assert shuffle_files(spark) <= before
    assert spark.read.parquet(path).count() == 1000
    assert rows.count() == rows.count() == 1000  # what was written can be read again
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_overlapping_writes_give_the_setting_back(spark):
    setting = spark.conf.get(SHUFFLE_CLEANUP)
    first, second = shuffles_removed(spark), shuffles_removed(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_task_input_is_bounded_and_own_settings_stay(spark):
    session = spark.newSession()
    (scan, (_, bounded)), (shuffle, _) = TASK_INPUT.items()
    session.conf.set(shuffle, "5m")
    bounded_tasks(session)
    assert session.conf.get(scan) == bounded
    assert session.conf.get(shuffle) == "5m"


def test_row_groups_are_no_larger_than_a_task(spark, tmp_path):
    write_rows(spark.range(6_000_000).selectExpr("xxhash64(id) as a").coalesce(1), str(tmp_path / "t"))
    (name,) = [f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    file = pq.ParquetFile(tmp_path / "t" / name).metadata
    assert max(file.row_group(i).total_byte_size for i in range(file.num_row_groups)) <= 1.1 * ROW_GROUP_BYTES


def test_derived_columns_are_not_shuffled(warehouse):
    rows = build_fact({t: warehouse.clean(t) for t in TABLES}, warehouse.calendar(), by_month=True)
    shuffled = rows._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions")[1]
    assert "profit_usd" not in shuffled and "line_total_usd" not in shuffled and "customer_age_at_purchase" not in shuffled


def test_columns_stay_in_their_order(warehouse, fact):
    whole = warehouse.build_fact()
    assert whole.columns == fact_columns(warehouse.clean("transactions").columns)
    parts = ["purchase_year", "purchase_month"]
    assert fact.columns == [c for c in whole.columns if c not in parts] + parts
    assert whole.exceptAll(fact.select(whole.columns)).isEmpty() and fact.select(whole.columns).exceptAll(whole).isEmpty()


def test_raw_lines_are_not_written(warehouse, fact):
    assert not warehouse.written("raw_transactions")


def test_deliveries_are_made_in_one_run(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "write_rows", lambda rows, path, **by: made.append(path) or write_rows(rows, path, **by))
    monkeypatch.setattr(catalog.FactFollower, "follow_and_wait", lambda self, stream, checkpoint: None)
    raw = {name: to_snake(df) for name, df in adapter.raw_tables(spark, SF_DIR).items()}
    w = Warehouse(spark, raw, new_folder(spark, "warehouse"), sf_dir=SF_DIR)
    catalog._follower(w)
    assert made == [f"{w.root}/deliveries"] and not exists(spark, made[0])
    w.close()


def test_followed_deliveries_go(spark):
    raw = {name: to_snake(df) for name, df in adapter.raw_tables(spark, SF_DIR).items()}
    w = Warehouse(spark, raw, new_folder(spark, "warehouse"), sf_dir=SF_DIR)
    followed = catalog._follower(w).fact()
    assert not exists(spark, f"{w.root}/delivered")
    assert followed.exceptAll(w.fact().select(followed.columns)).isEmpty()
    assert w.fact().select(followed.columns).exceptAll(followed).isEmpty()
    w.close()


@pytest.fixture
def unicast(spark):
    """A warehouse in a session that broadcasts nothing, as if every table were large."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "8")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    raw = {name: to_snake(df) for name, df in adapter.raw_tables(session, SF_DIR).items()}
    w = Warehouse(session, raw, new_folder(session, "warehouse"), sf_dir=SF_DIR)
    yield w
    w.close()


def test_wide_lines_are_not_shuffled_for_large_dimensions(unicast, warehouse, fact):
    assert unicast.passes() == list(PASSES) and warehouse.passes() == []
    whole = unicast.build_fact()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # of the join with the calendar, which does not grow with the lines
    assert plan.count("SortMergeJoin") <= 1
    rows = spark_rows(whole)
    assert rows == spark_rows(fact.select(whole.columns))


def test_tables_in_buckets_go_when_the_fact_is_written(unicast, fact):
    made = unicast.fact()
    assert spark_rows(made) == spark_rows(fact.select(made.columns))
    assert [t.name.startswith("bazaar_transactions_") for t in unicast.spark.catalog.listTables()] == [True]
    assert not any(name in os.listdir(unicast.root) for name in ("valid_lines", "lines_by_customer_id", "customers_by_key"))
    unicast.close()
    assert not unicast.spark.catalog.listTables() and not exists(unicast.spark, unicast.root)


def spark_rows(df):
    return sorted(map(repr, df.collect()))


def test_lines_are_gathered_before_they_are_widened(warehouse):
    rows = build_fact({t: warehouse.clean(t) for t in TABLES}, warehouse.calendar(), by_month=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Join LeftOuter") < plan.index("RebalancePartitions")  # every join is above, none below


@pytest.mark.parametrize(("own", "held"), [(None, METHOD_BYTES[2]), ("20000", "20000")])
def test_methods_that_the_jvm_does_not_compile_are_not_generated(spark, own, held):
    session = spark.newSession()
    if own:
        session.conf.set(METHOD_BYTES[0], own)
    bounded_tasks(session)
    assert int(METHOD_BYTES[2]) <= 8000 and session.conf.get(METHOD_BYTES[0]) == held


def test_lines_in_buckets_are_widened_by_date(unicast, fact):
    """Otherwise a task goes from one month's file to another with every wide line."""
    plan = unicast.build_fact(by_month=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [date#") == 1 and plan.index("ShuffledHashJoin [customer_id") < plan.index("Sort [date#")
    assert spark_rows(unicast.build_fact(by_month=True).select(fact.columns)) == spark_rows(fact)


def test_copies_are_sorted_by_a_hash_first(spark):
    rows = spark.createDataFrame([("INV-1", None, 2), ("INV-1", None, 1), ("INV-1", 3, 1), (None, 3, 5)], "k string, n int, v int")
    once = keep_first(rows, ["k", "n"])
    sorts = [line for line in once._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and all(line.split("Sort [")[1].startswith("_w0") for line in sorts)
    assert sorted(map(repr, (tuple(r) for r in once.collect()))) == ["('INV-1', 3, 1)", "('INV-1', None, 1)", "(None, 3, 5)"]
