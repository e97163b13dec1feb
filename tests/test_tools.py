"""DataFrame helpers, streams, custom sources and help for editors."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from quillon import suite
from quillon.operators import frame
from quillon.plans.assist import complete, joins, signatures
from quillon.plans.query import Query
from quillon.sources.catalog import DataContext, Relation
from quillon.streaming import query as streaming

from .conftest import DATA


@pytest.fixture
def nation(spark):
    return spark.read.parquet(f"{DATA}/nation.parquet")


def test_frame_helpers(spark, nation):
    assert frame.top_with_ties(nation, 3, "n_regionkey").count() == 5
    row = nation.agg(frame.concat_distinct(F.lit(" x ")).alias("a"), frame.average("n_nationkey", True).alias("b")).first()
    assert tuple(row) == ("x", 12)
    supplier = spark.read.parquet(f"{DATA}/supplier.parquet")
    some = frame.holds_for_any(nation, supplier, nation.n_nationkey == supplier.s_nationkey)
    none = frame.holds_for_all(nation, supplier, nation.n_nationkey != supplier.s_nationkey)
    assert some.count() + none.count() == 25
    region = spark.read.parquet(f"{DATA}/region.parquet")
    assert frame.auto_join(region, nation, [("r_regionkey", "n_regionkey")]).count() == 25
    assert spark.createDataFrame([("Pfister",)], "n string").select(frame.soundex("n")).first()[0] == "P123"


class Product:
    def init(self):
        self.value = 1

    def accumulate(self, x):
        self.value = self.value * (x + 1) % 1_000_003

    def merge(self, other):
        self.value = self.value * other.value % 1_000_003

    def terminate(self):
        return self.value


@pytest.mark.parametrize("held", [2, 1000])
def test_aggregate_by_states(spark, held):
    """Against one fold a group; a third of the rows in one group, nulls in keys and values, more groups than a task holds."""
    rows = [(None if k % 17 == 0 else "hot" if k % 3 == 0 else f"g{k % 40}", k % 2 == 0, None if k % 11 == 0 else k) for k in range(2000)]
    df = spark.createDataFrame([*rows, ("none", True, None)], "g string, even boolean, v long").repartition(5)
    want: dict = {}
    for g, even, v in [*rows, ("none", True, None)]:
        state = want.setdefault((g, even), 1)
        want[g, even] = state if v is None else state * (v + 1) % 1_000_003
    got = frame.aggregate_states(df, ["g", "even"], "v", Product, "p long", held=held)
    assert got.columns == ["g", "even", "p"]
    assert {(r.g, r.even): r.p for r in got.collect()} == want
    assert frame.aggregate_states(df, [], "v", Product, "p long").first().p == frame.aggregate_states(df.repartition(1), [], "v", Product, "p long").first().p
    assert frame.aggregate_states(df.limit(0), ["g"], "v", Product, "p long").collect() == []


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    text = "SELECT event_id, value * 2 AS v FROM events WHERE event_type LIKE '%e%'"
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    ctx = DataContext(spark)
    ctx.add_table("events", spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = streaming.start(streaming.stream(ctx, text), "out_stream", str(tmp_path / "state"))
    run.processAllAvailable()
    run.stop()
    want = Query(suite.context(spark, DATA, text), text).execute()
    assert sorted(spark.table("out_stream").collect()) == sorted(want.collect())


def test_custom_source(spark):
    class Reader(DataSourceReader):
        def read(self, partition):
            yield from [(1, "a"), (2, "b")]

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "two_rows"

        def schema(self):
            return "k int, t string"

        def reader(self, schema):
            return Reader()

    ctx = DataContext(spark)
    ctx.add_data_source("t", Source)
    assert Query(ctx, "SELECT CONCAT(t) FROM t WHERE k > 0").scalar() == "a, b"


def test_files(spark, tmp_path):
    spark.range(3).write.option("header", True).csv(str(tmp_path / "c"))
    spark.range(4).write.json(str(tmp_path / "j"))
    ctx = DataContext(spark)
    ctx.read("c", str(tmp_path / "c"), "csv", header=True, inferSchema=True)
    ctx.read("j", str(tmp_path / "j"), "json")
    assert Query(ctx, "SELECT COUNT(*) FROM c JOIN j ON c.id = j.id").scalar() == 3


def test_assistance(spark):
    ctx = suite.context(spark, DATA, "nation region")
    ctx.add_relation(Relation("region", "nation", ("r_regionkey",), ("n_regionkey",)))
    text = "SELECT n. FROM nation n JOIN region r ON "
    assert {p.text for p in complete(ctx, text, 9)} == {"n_nationkey", "n_name", "n_regionkey"}
    assert complete(ctx, text, len(text))[0].text == "n.n_regionkey = r.r_regionkey"
    assert any(p.kind == "function" for p in complete(ctx, "SELECT LE FROM nation", 9))
    assert signatures(ctx, "lpad") == ["LPAD(string, int) -> string"]
    assert joins(ctx, []) == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
