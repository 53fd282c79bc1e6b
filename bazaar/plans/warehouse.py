"""From raw tables to written clean tables, the promotion calendar and the sales fact.

Reports, features and models read the written fact, as a dashboard or a training job would: the joins are paid once, a
report scans only its columns, and a lost executor costs a re-read instead of a rebuild. Clean tables are written before
the fact is joined: raw JSON is parsed once, the range of sales days is a scan of one column, and Spark decides on
broadcasting a dimension or the calendar by the size of real files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from bazaar.contract import TABLES, to_snake
from bazaar.operators.clean import RULES, clean, valid_rows
from bazaar.operators.dedup import keep_first
from bazaar.operators.fact import DIMENSIONS as JOINED
from bazaar.operators.fact import build_fact, in_order, join_dimension
from bazaar.operators.promotions import promo_calendar, sales_days
from bazaar.sources import adapter
from bazaar.sources.files import remove, size
from bazaar.sources.sinks import write_buckets, write_fact, write_rows, write_table
from bazaar.sources.workspace import bounded_tasks, new_folder

DIMENSIONS = tuple(t for t in TABLES if t != "transactions")
LINES = "transactions"

#: Dimensions by what they add to a line in a file: what adds little is joined first, because later passes write it again.
PASSES = ("stores", "products", "employees", "customers")
#: Input of a bucket of lines, one and a half million of the star schema: a task de-duplicates a bucket in memory.
BUCKET_BYTES = 24 << 20
LEAST_BUCKETS = 8


class Warehouse:
    """Tables over one set of raw tables (snake_case, strings). Each is written at first use and read from then on.

    Raw tables named in ``land`` are themselves results of a job, and are written before they are cleaned.
    """

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], root: str, land: Sequence[str] = (), sf_dir: str = ""):
        self.spark = spark
        self.sf_dir = sf_dir
        self.root = root
        self._sources = raw
        self._land = land
        self._written: dict[str, DataFrame] = {}
        self._made: dict[str, object] = {}
        self._buckets: dict[str, str] = {}  # tables in buckets: their names in the catalog

    def raw(self, name: str) -> DataFrame:
        if name not in self._land:
            return self._sources[name]
        return self.table(f"raw_{name}", lambda: self._sources[name], write_rows)

    def table(self, name: str, make: Callable[[], DataFrame], write=write_table) -> DataFrame:
        if name not in self._written:
            path = f"{self.root}/{name}"
            write(make(), path)
            self._written[name] = self.spark.read.parquet(path)
        return self._written[name]

    def once(self, name: str, make: Callable[[], object]) -> object:
        """What ``make`` returned when it was first asked for under this name."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def written(self, name: str) -> bool:
        return name in self._written

    def clean(self, name: str) -> DataFrame:
        """A clean table. Transactions are written as their tasks hold them: an even hash partitioning by line key."""
        write = write_rows if name == "transactions" else write_table
        return self.table(name, lambda: clean(name, self.raw(name)), write)

    def sales_days(self) -> DataFrame:
        return self.table("sales_days", lambda: sales_days(self.clean("transactions")))

    def calendar(self) -> DataFrame:
        return self.table("promo_calendar", lambda: promo_calendar(self.clean("discounts"), self.sales_days()))

    def prepare(self) -> None:
        """Write everything the fact needs. The dimensions do not depend on each other, so their jobs share the cluster; their
        sizes decide how lines are kept."""
        with ThreadPoolExecutor(len(DIMENSIONS)) as pool:
            for job in [pool.submit(self.clean, name) for name in DIMENSIONS]:
                job.result()
        if self.passes() and not self.written(LINES):
            self._lines_in_buckets()
        self.calendar()

    def passes(self) -> list[str]:
        """Dimensions whose files are too large for Spark to broadcast."""
        most = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        for name in PASSES:
            self.clean(name)
        return [name for name in PASSES if size(self.spark, f"{self.root}/{name}") > most]

    def buckets(self) -> int:
        """How many buckets of lines there are, by the size of the files that the raw lines come from."""
        count = lambda: sum(size(self.spark, f) for f in self.raw(LINES).inputFiles())
        return max(LEAST_BUCKETS, -(-self.once("line_bytes", count) // BUCKET_BYTES))

    def _in_buckets(self, name: str, key: str, rows: DataFrame) -> DataFrame:
        """A table in buckets of a key, under a name that no other warehouse uses."""
        if name not in self._written:
            self._buckets[name] = f"bazaar_{name}_{uuid.uuid4().hex}"
            self._written[name] = write_buckets(rows, f"{self.root}/{name}", self._buckets[name], key, self.buckets())
        return self._written[name]

    def _drop(self, name: str) -> None:
        del self._written[name]
        self.spark.sql(f"DROP TABLE IF EXISTS {self._buckets.pop(name)}")
        remove(self.spark, f"{self.root}/{name}")

    def _lines_in_buckets(self) -> None:
        """The clean lines, in buckets of the first key that they are joined by; copies of a line meet in buckets of invoices."""
        rule = RULES[LINES]
        valid = self._in_buckets("valid_lines", rule.key[0], valid_rows(LINES, self.raw(LINES)))
        self._in_buckets(LINES, JOINED[self.passes()[0]].key, keep_first(valid, rule.key, rule.first))
        self._drop("valid_lines")

    def _pass(self, lines: DataFrame, name: str, last: str | None, by_date: bool = False) -> DataFrame:
        """Lines with the attributes of one dimension, both in buckets of its key. The dimension's part of a bucket is hashed, so
        lines are not shuffled. ``last`` names the dimension joined before. With ``by_date`` lines come in the order of their dates."""
        key = JOINED[name].key
        table = LINES if last is None and LINES in self._buckets else f"lines_by_{key}"
        lines = self._in_buckets(table, key, lines)
        if last and f"lines_by_{JOINED[last].key}" in self._buckets:
            self._drop(f"lines_by_{JOINED[last].key}")
        rows = self._in_buckets(f"{name}_by_key", key, self.clean(name))
        return join_dimension(in_order(lines, "date", key) if by_date else lines, rows.hint("shuffle_hash"), name)

    def build_fact(self, by_month: bool = False) -> DataFrame:
        """The fact; dimensions that Spark would not broadcast are joined one after another by way of tables in buckets, because
        their shuffles of wide lines would be many times the lines' files."""
        self.prepare()
        clean_tables, passes = {t: self.clean(t) for t in TABLES}, self.passes()
        if not passes:
            return build_fact(clean_tables, self.calendar(), by_month)
        lines = clean_tables[LINES]
        for last, name in zip([None, *passes], passes):
            lines = self._pass(lines, name, last, by_date=by_month and name == passes[-1])
        return build_fact(clean_tables, self.calendar(), by_month, (lines, passes))

    def close(self) -> None:
        """Remove every table that was written; whoever still reads one fails, and the next use writes anew."""
        for name in list(self._buckets):
            self._drop(name)
        self._written.clear()
        self._made.clear()
        remove(self.spark, self.root)

    def fact(self) -> DataFrame:
        before = set(self._buckets)
        fact = self.table("fact_transactions", lambda: self.build_fact(by_month=True), partial(write_fact, gathered=True))
        for name in set(self._buckets) - before - {LINES}:  # what only led to the fact
            self._drop(name)
        return fact


_open: dict[tuple[str, str], Warehouse] = {}


def open_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse over the star schema in ``sf_dir``; one per Spark application and folder, until ``close_warehouse``."""
    where = (spark.sparkContext.applicationId, sf_dir)
    bounded_tasks(spark)
    if where not in _open:
        raw = {name: to_snake(df) for name, df in adapter.raw_tables(spark, sf_dir).items()}
        _open[where] = Warehouse(spark, raw, new_folder(spark, "warehouse"), sf_dir=sf_dir)
    return _open[where]


def close_warehouse(spark: SparkSession, sf_dir: str) -> None:
    """Forget the warehouse over ``sf_dir`` and remove its tables."""
    warehouse = _open.pop((spark.sparkContext.applicationId, sf_dir), None)
    if warehouse:
        warehouse.close()
