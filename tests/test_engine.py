"""The builder, tiers, key/value tables, extents, logs and codecs on small fixtures."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import bag, expected
from tidewell.functions import codecs
from tidewell.operators import column, index, kv
from tidewell.plans import registry
from tidewell.plans.query import Select
from tidewell.plans.registry import DRIVE
from tidewell.plans.schema import FloatField, ForeignKey, IntegerField, StringField, Table
from tidewell.sources import textfiles, values
from tidewell.sources.tiers import TieredStore, assign_pk, upsert
from tidewell.sources.warehouse import Database, Warehouse
from tidewell.streaming import oplog, traces


class Address(Table):
    addr_type = IntegerField()


class Person(Table):
    first_name = StringField(required=True)
    age = IntegerField(default=5)
    score = FloatField(default=lambda: 1.5)
    address_id = ForeignKey(Address)


def test_declarations():
    assert list(Person.fields) == ["person_id", "first_name", "age", "score", "address_id"]
    assert Person.create_table() == (
        "CREATE TABLE IF NOT EXISTS person (person_id BIGINT NOT NULL, first_name STRING NOT NULL, age BIGINT DEFAULT 5, score DOUBLE, address_id BIGINT) USING parquet"
    )
    assert Person.schema()["address_id"].metadata["references"] == "address.address_id"
    row = Person.new(first_name="jessica")
    assert (row["age"], row["score"]) == (5, 1.5)
    with pytest.raises(TypeError):
        Person.new(first_name=3)
    with pytest.raises(TypeError):
        Person.age == "x"  # noqa: B015
    with pytest.raises(LookupError):
        Select(Address, None).join(Person.person_id)


def test_null_and_empty_predicates(spark):
    rows = spark.createDataFrame([(1, 10), (2, None)], "address_id long, addr_type long")
    query = Select(Address, lambda t: rows)
    assert query.where(Address.addr_type == None).df().count() == 0  # noqa: E711
    assert query.where(Address.addr_type.found_in([])).df().count() == 0
    assert query.where((Address.addr_type == 10) | (Address.address_id == 2)).df().count() == 2


@pytest.mark.parametrize("flushed", [0, 1, 3])
def test_results_do_not_depend_on_the_tier(spark, tmp_path, flushed):
    store = TieredStore(spark, str(tmp_path))
    places = store.save(Address, [Address.new(addr_type=t) for t in (10, 20, 30)])
    store.save(Person, [Person.new(first_name=n, address_id=p["address_id"]) for n, p in zip("abc", places, strict=True)])
    if flushed:
        store.move(Address, flushed)
        store.move(Person, 3 - flushed)
    query = store.starting_with(Person).select(Person.first_name, Address.addr_type).join(Address.address_id)
    assert sorted((r.first_name, r.addr_type) for r in query.rows()) == [("a", 10), ("b", 20), ("c", 30)]
    places[0]["addr_type"] = 11
    assert places[0].dirty == {"addr_type": 10}
    store.save(Address, places[:1])
    assert store.read(Address).count() == 3
    store.delete(Address, store.read(Address).where("addr_type = 11"))
    assert store.read(Address).count() == 2
    store.compact(Address)
    assert sorted(r.addr_type for r in store.read(Address).collect()) == [20, 30]


def test_updates_set_dirty_and_non_null_fields_only(spark, tmp_path):
    store = TieredStore(spark, str(tmp_path))
    row = Person.new(first_name="a", address_id=7)
    store.save(Person, [row])
    store.move(Person)
    row["age"] = None
    row["score"] = 2.5
    other = Person.new(first_name="b")
    other["person_id"] = 5
    store.update(Person, spark.sql("SELECT 0L AS person_id, 'z' AS first_name, CAST(NULL AS DOUBLE) AS score"))
    store.save(Person, [row, other, Person.new(first_name="c")])
    found = {r.person_id: (r.first_name, r.age, r.score, r.address_id) for r in store.read(Person).collect()}
    # The object's own first name isn't null, so it is set again.
    assert found == {0: ("a", None, 2.5, 7), 5: ("b", 5, 1.5, None), 1: ("c", 5, 1.5, None)}
    store.put(Person, store.read(Person).where("person_id = 5").withColumn("first_name", F.lit("d")))
    store.save(Person, [Person.new(first_name="e")])
    assert sorted((r.person_id, r.first_name) for r in store.read(Person).collect()) == [(0, "a"), (1, "c"), (5, "d"), (6, "e")]


def test_bootstrap_and_catalog(spark, tmp_path):
    store = TieredStore(spark, str(tmp_path))
    assert store.tables().count() == 0 and store.read(Address).count() == 0
    store.bootstrap(Address, Person)
    store.bootstrap(Address)
    assert [r[0] for r in store.tables().orderBy("table_name").collect()] == ["address", "person"]

    class Other(Table):
        table_name = "address"
        text = StringField()

    with pytest.raises(ValueError, match="other fields"):
        store.bootstrap(Other)


def test_two_writers(spark, tmp_path):
    store = TieredStore(spark, str(tmp_path))
    old = store._state(Address)
    store.save(Address, [Address.new(addr_type=1)])
    with pytest.raises(RuntimeError, match="another writer"):
        store._set(Address, old)
    assert store.read(Address).count() == 1


def test_upsert_of_repeated_keys(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') AS t(k, v)")
    new = spark.sql("SELECT * FROM VALUES (2L, 'x', 1), (2L, 'c', 2), (3L, 'd', 1) AS t(k, v, n)")
    assert sorted(map(tuple, upsert(rows, new, "k", "n").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, upsert(rows, new.drop("n"), "k").collect())) == [(1, "a"), (2, "x"), (3, "d")]


def test_warehouse_and_databases(spark, tmp_path):
    house = Warehouse(spark, f"{tmp_path}/w")
    assert not house.exists()
    with pytest.raises(LookupError):
        house.get()
    house.create().set("port", 50000)
    assert house.get() == {"port": 50000} and house.get("none") is None
    db = Database(house, "d1")
    assert not db.exists() and db.status() is None
    db.create()
    assert db.status() == {"name": "d1", "state": "locked"}
    with pytest.raises(ConnectionError):
        db.connect()
    db.release()
    db.start()
    assert db.status()["state"] == "stopped"
    house.start()
    db.connect().save(Address, [Address.new(addr_type=1)])
    status = Database(Warehouse(spark, f"{tmp_path}/w"), "d1").status("complete")
    assert (status["state"], status["tables"], status["bytes"] > 0) == ("running", 1, True)
    assert house.status("common").count() == 1
    db.stop()
    assert db.status()["state"] == "stopped"
    db.destroy()
    assert house.status().count() == 0 and not (tmp_path / "w" / "d1").exists()
    house.destroy()
    assert not house.exists()
    with pytest.raises(ValueError, match="name"):
        Database(house, "../x")


def test_value_store(spark, tmp_path):
    raw = [bytes([k]) * (k % 5 * 20) for k in range(40)]
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in enumerate(raw)], "k long, value binary")
    for mode in (values.PACKED, values.COMPRESSED, values.USER, values.USER_COMPRESSED):
        store = values.ValueStore(spark, f"{tmp_path}/{mode}", mode)
        assert store.append(rows.where("k < 25"), ["k"]) == (0, 25) and store.append(rows.where("k >= 25"), ["k"]) == (25, 40)
        again = values.ValueStore(spark, f"{tmp_path}/{mode}", values.PACKED_INT)
        assert again.mode == mode and again.count() == 40
        assert {r.ordinal: bytes(r.value) for r in again.get([3, 30]).collect()} == {3: raw[3], 30: raw[30]}
    ints = [0, 1, -1, 256, 900, -900, 2**63 - 1, -(2**63)]
    store = values.ValueStore(spark, f"{tmp_path}/ints", values.PACKED_INT)
    store.append(spark.createDataFrame([(v,) for v in ints], "value long"), ["value"])
    assert sorted(r.value for r in store.get().collect()) == sorted(ints)
    with pytest.raises(ValueError, match="encoding"):
        values.ValueStore(spark, f"{tmp_path}/none", 9)


def test_offset_array(spark, tmp_path):
    array = values.OffsetArray(spark, str(tmp_path))
    assert array.count() == 0
    array.append(spark.range(0, 1000, 100).withColumnRenamed("id", "offset"), ["offset"])
    array.append(spark.sql("SELECT 7L AS offset"), ["offset"])
    array.delete(spark.sql("SELECT 3L AS ordinal"))
    array.update(spark.sql("SELECT * FROM VALUES (4L, 5L), (99L, 5L) AS t(ordinal, offset)"))
    again = values.OffsetArray(spark, str(tmp_path))
    assert [again.get(k) for k in (0, 3, 4, 9, 10, 99)] == [0, 0, 5, 900, 7, None] and again.count() == 11


def test_cascade(spark, tmp_path):
    """Levels of 4, 8 and 16 entries; filters take back entries, of which those for nothing end on the last level."""
    tree = index.Cascade(spark, str(tmp_path), 4, 2, 3)
    batch = lambda *rows: spark.createDataFrame(list(rows), "key long, ptr long, is_filter boolean")
    tree.add(batch(*[(k, k, False) for k in range(5)]))
    assert tree.entries == [0, 5, 0] and tree.merges == [0, 1, 0]
    tree.add(batch((0, 0, True), (77, 1, True), (9, 9, False)))
    assert tree.entries == [3, 5, 0] and sorted(r.key for r in tree.rows().collect()) == [1, 2, 3, 4, 9]
    tree.add(batch(*[(k, k, False) for k in range(20, 27)]))
    assert tree.entries == [0, 0, 12] and tree.merges == [0, 0, 1] and tree.all_merges == [0, 2, 1]
    assert sorted(r.key for r in tree.rows().collect()) == [1, 2, 3, 4, 9, *range(20, 27)]


def simulated_cost(n, memory, p, k, page=2048, entry=8, f=252):
    """The cost model by objects of levels: a second version of it."""
    drive = DRIVE
    size = [256 * page // entry]
    while size[-1] < n:
        size.append(size[-1] * k)
    top = len(size) - 1
    level = [{"n": 0, "f": 0} for _ in size]
    level[top]["n"] = n
    for i in range(top - 1, -1, -1):
        level[i]["f"] = level[i + 1]["n"] // f
        level[i]["n"] = (size[i] - level[i]["f"]) // 2 + level[i]["f"]
    io = {"r": 0, "w": 0}

    def merge(i):
        deepest = i
        io["r"] += level[i]["n"] + (0 if i == 1 else level[i - 1]["n"])
        io["w"] += level[i]["n"] + level[i - 1]["n"] - level[i - 1]["f"]
        level[i]["n"] += size[i - 1] - level[i - 1]["f"]
        if level[i]["n"] >= size[i] and i < top:
            deepest = merge(i + 1)
        level[i - 1]["f"] = level[i]["n"] // f
        level[i - 1]["n"] += level[i - 1]["f"] - size[i - 1]
        return deepest

    inserted = 0
    while True:
        level[0]["n"] = size[0]
        inserted += size[0] - level[0]["f"]
        if merge(1) == top:
            break
    insert = (io["r"] * entry / drive["seqread"] + io["w"] * entry / drive["seqwrite"]) / inserted
    m = 1 + math.floor(math.log(memory / (size[0] * entry)) / math.log(k))
    search = (len(size) - m - (memory - int(size[0] * k ** (m - 1)) * entry) / size[m] / entry) * page / drive["rndread"]
    return search * (1 - p) + insert * p


def test_cost_model(spark):
    for n, p in ((1 << 30, 0.2), (100_000_000, 0.5), (50_000_000, 0.9)):
        found = {r.k: r.cost for r in index.fan_out_costs(spark, n, 16 << 20, p, DRIVE).collect()}
        assert sorted(found) == list(range(4, 251))
        assert all(found[k] == pytest.approx(simulated_cost(int(n * 1.05), 16 << 20, p, k)) for k in (4, 9, 50, 130, 250))
        best = index.best_fan_out(spark, n, 16 << 20, p, DRIVE).first()
        assert best.k == min(found, key=lambda k: (found[k], k)) and best.cost == min(found.values())


def test_prefixes(spark):
    rows = spark.createDataFrame([("apple", 1), ("apple", 1), ("cat", 2), ("calf", 3), ("", 4), (None, 5)], "key string, n int")
    prefixes = spark.createDataFrame([("ap",), ("app",), ("ca",), ("ca",), ("zzzzzz",), (None,)], "prefix string")
    assert sorted(map(tuple, index.prefix_membership(rows, prefixes, "key").collect())) == [("apple", 1), ("apple", 1), ("calf", 3), ("cat", 2)]
    assert index.prefix_membership(rows, prefixes.limit(0), "key").count() == 0


def test_sums(spark):
    big = [10**16 + 1, 10**16 + 1, -3]
    assert column.fold_sum(spark.createDataFrame([(v,) for v in big], "value long")).first()[0] == float(sum(big))
    assert column.fold_sum(spark.createDataFrame([(1e-5,), (2e-5,)], "value double")).first()[0] == pytest.approx(3e-5)
    assert column.fold_sum(spark.createDataFrame([], "value double")).first()[0] == 0.0
    assert column.fold_product(spark.createDataFrame([(2.0,), (2.0,), (-3.0,)], "value double")).first()[0] == -12.0


def test_text_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("s 1\n\n i 4 32543\nd 7\n")
    (tmp_path / "a.txt").write_text("u 3 34653\n")
    rows = [tuple(r) for r in textfiles.read_oplog(spark, str(tmp_path)).orderBy("seq").collect()]
    assert rows == [(0, "u", 3, 34653), (1, "s", 1, None), (2, "i", 4, 32543), (3, "d", 7, None)]
    (tmp_path / "in.dat").write_text("(1,35432) (3,236564)\n7 256523\n")
    assert [tuple(r) for r in textfiles.read_entries(spark, f"{tmp_path}/in.dat").orderBy("pos").collect()] == [(0, 1, 35432), (1, 3, 236564), (2, 7, 256523)]
    (tmp_path / "drive.dat").write_text("#a drive\nrndread:\t17000000\nseqwrite:\t72000000\n")
    assert textfiles.read_profile(spark, f"{tmp_path}/drive.dat") == {"rndread": 17000000, "seqwrite": 72000000}


def test_replay_of_hot_and_many_keys(spark):
    rng = random.Random(3)
    log = [(k, rng.choice("sidu"), rng.choice([1, 1, 1, rng.randint(2, 300)]), rng.randint(0, 50)) for k in range(5000)]
    live, searches = {}, []
    for seq, op, key, ptr in log:
        own = live.setdefault(key, [])
        if op == "s":
            searches.append((seq, key, len(own), min(own, default=None)))
        if op in "du" and own:
            own.remove(min(own))
        if op in "iu":
            own.append(ptr)
    rows = spark.createDataFrame(log, "seq long, op string, key long, ptr long")
    assert sorted(map(tuple, oplog.final_state(rows).collect())) == sorted((k, p) for k, own in live.items() for p in own)
    assert sorted(map(tuple, oplog.search_results(rows).collect())) == searches


def test_replay_stream(spark, tmp_path):
    schema = "seq long, op string, key long, ptr long"
    log = [(0, "i", 1, 9), (1, "i", 1, 4), (2, "u", 1, 7), (3, "d", 2, 0), (4, "i", 2, 5), (5, "d", 1, 0)]
    for k in range(3):
        spark.createDataFrame(log[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = {}
    land = lambda batch, _: seen.update({r.key: r.ptrs for r in batch.collect()})
    oplog.replay_stream(stream).writeStream.foreachBatch(land).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == {1: [9], 2: [5]}


def test_long_intervals(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.choice([1, 5, 300, 4000])) for a in (rng.randint(-500, 30000) for _ in range(40))] + [(5, 5), (9, 3)]
    covered = {x for a, b in spans for x in range(a, b)}
    want = [(a, next(x for x in range(a, 10**6) if x not in covered)) for a in sorted(covered) if a - 1 not in covered]
    rows = spark.createDataFrame(spans, "start long, end long")
    for block in (7, 64, 1 << 20):
        assert sorted(map(tuple, kv.coalesce_extents(rows, block).select("start", "end").collect())) == want


def test_first_fit(spark):
    rng = random.Random(5)
    spans = [(100 * k, 100 * k + rng.randint(1, 60)) for k in range(37)]
    asked = [(k, rng.randint(1, 50)) for k in range(80)]
    free, want = [list(s) for s in spans], []
    for seq, count in asked:
        fit = next((s for s in free if s[1] - s[0] >= count), None)
        want.append((seq, fit and fit[0]))
        if fit:
            fit[0] += count
    found = kv.first_fit(spark.createDataFrame(spans, "start long, end long"), spark.createDataFrame(asked, "seq long, count long"))
    assert sorted(map(tuple, found.collect())) == want
    assert kv.first_fit(spark.createDataFrame([], "start long, end long"), spark.createDataFrame(asked[:1], "seq long, count long")).first()[1] is None


def test_assign_pk(spark):
    rows = assign_pk(spark.range(1000).withColumn("v", -F.col("id")), "pk", 9, ["v"]).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["pk"])] == list(range(999, -1, -1))
    assert sorted(r["pk"] for r in rows) == list(range(10, 1010))


@pytest.fixture
def many_ranges(spark):
    """Small partitions stay apart, as those of large tables do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_assign_pk_over_sampled_ranges(spark, many_ranges):
    """Borders come from a sample; numbers have no gaps where columns beside the order are kept."""
    wide = spark.range(20000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("other"))
    assert sorted((r["pk"], r["id"]) for r in assign_pk(wide, "pk", 0, ["id"]).select("pk", "id", "other").collect()) == [(k + 1, k) for k in range(20000)]


def test_long_oplog_file(spark, tmp_path, many_ranges):
    lines = [f"i {k % 77} {k}" for k in range(20000)]
    for part in range(4):
        (tmp_path / f"{part}.txt").write_text("\n".join(lines[part * 5000 : part * 5000 + 5000]) + "\n")
    rows = textfiles.read_oplog(spark, str(tmp_path)).select("seq", "op", "key", "ptr").collect()
    assert sorted(map(tuple, rows)) == [(k, "i", k % 77, k) for k in range(20000)]


def test_sorted_keys_with_ties(spark, tmp_path, many_ranges):
    names = ["small ", "\u00e9", "Z", "a", "\U0001f600"]
    spark.range(20000).select(F.col("id").alias("p_partkey"), F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int") + 1).alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    found = registry.sorted_keys(spark, str(tmp_path)).toPandas()
    assert bag(found) == bag(expected(registry.oracle_sql()["sorted_keys"], part=f"{tmp_path}/part.parquet/*.parquet"))


def test_sorted_keys_with_nulls(spark, tmp_path):
    """The SQL has nulls last."""
    rows = [(3, "b"), (None, "b"), (2, None), (1, "a"), (None, "a"), (4, "")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = registry.sorted_keys(spark, str(tmp_path)).toPandas()
    assert bag(found) == bag(expected(registry.oracle_sql()["sorted_keys"], part=f"{tmp_path}/part.parquet/*.parquet"))


def _odd_tables(spark, path) -> dict[str, str]:
    """Events and documents with null keys and texts, and texts of other alphabets."""
    events = [(3, "view"), (None, "error"), (1, None), (2, ""), (7000, "signup")]
    docs = [(5, "en", "web"), (None, "zz", "news"), (1, None, "web"), (2, "h\u00e9\U0001f600", "x"), (4, "\u65e5\u672c\u8a9e\u3067", "y"), (3, "", "")]
    spark.createDataFrame(events, "event_id long, event_type string").coalesce(1).write.parquet(f"{path}/events.parquet")
    spark.createDataFrame(docs, "doc_id long, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return {t: f"{path}/{t}.parquet/*.parquet" for t in ("events", "documents")}


def test_value_store_of_nulls_and_alphabets(spark, tmp_path):
    """Nulls come last, and the user's mode cuts at characters."""
    tables = _odd_tables(spark, tmp_path)
    found = registry.value_store(spark, str(tmp_path)).toPandas()
    assert bag(found) == bag(expected(registry.oracle_sql()["value_store"], **tables))


def test_value_translator_with_nulls(spark, tmp_path):
    tables = _odd_tables(spark, tmp_path)
    found = registry.value_translator(spark, str(tmp_path)).toPandas()
    assert bag(found) == bag(expected(registry.oracle_sql()["value_translator"], **tables))


def test_value_store_of_many_values(spark, tmp_path, many_ranges):
    rows = spark.range(20000, numPartitions=8).select("id", F.encode(F.sha2(F.col("id").cast("string"), 256), "UTF-8").alias("value"))
    want = {r["id"]: bytes(r["value"]) for r in rows.collect()}
    store = values.ValueStore(spark, str(tmp_path / "store"), values.PACKED)
    assert store.append(rows, ["id"]) == (0, 20000)
    assert {r.ordinal: bytes(r.value) for r in store.get().collect()} == want


def test_translated_values_of_many_events(spark, tmp_path, many_ranges):
    kinds = F.element_at(F.array(*map(F.lit, ("view", "click", "error"))), (F.col("id") % 3).cast("int") + 1)
    spark.range(20000).select((F.col("id") * 7).alias("event_id"), kinds.alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    found = registry.value_translator(spark, str(tmp_path)).toPandas()
    assert bag(found) == bag(expected(registry.oracle_sql()["value_translator"], events=f"{tmp_path}/events.parquet/*.parquet"))


def test_runs_over_block_borders(spark):
    values = [(i, "x" if i < 50 or i == 70 else "y") for i in range(100) if i != 60]
    rows = spark.createDataFrame(values, "row_id long, value string")
    want = {("x", 0, 49), ("x", 70, 70), ("y", 50, 59), ("y", 61, 69), ("y", 71, 99)}
    for block in (7, 1000):
        assert {tuple(r) for r in column.islands(rows, block).collect()} == want
    assert sorted(map(tuple, column.rle_decode(column.rle_encode(rows)).collect())) == values


def test_fold_order(spark):
    rows = spark.createDataFrame([(3,), (1,), (1,), (2,)], "value long")
    assert column.fold(rows, lambda v, a, n: a * 10 + v * n).first()[0] == 223


def test_versions(spark, tmp_path):
    table = kv.VersionedTable(spark, str(tmp_path))
    table.put(spark.sql("SELECT 100L AS key, 500L AS value"))
    table.commit()
    table.put(spark.sql("SELECT 100L AS key, 250L AS value"))
    assert table.get(100) == 250
    table.rollback()
    assert table.get(100) == 500 and len(table.checksum()) == 64
    table.delete(spark.sql("SELECT 7L AS key"))
    assert table.get(7) is None
    again = kv.VersionedTable(spark, str(tmp_path))
    assert again.version == 1 and again.get(100) == 500
    again.verify()
    spark.sql("SELECT 100L AS key, 501L AS value").write.mode("overwrite").parquet(f"{tmp_path}/v1")
    with pytest.raises(kv.IntegrityError):
        kv.VersionedTable(spark, str(tmp_path)).verify()
    small = kv.VersionedTable(spark, f"{tmp_path}/small", capacity=2)
    small.put(spark.range(2).select(F.col("id").alias("key"), F.col("id").alias("value")))
    with pytest.raises(OverflowError):
        small.put(spark.sql("SELECT 7L AS key, 7L AS value"))


def test_extents(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.randint(0, 40)) for a in (rng.randint(0, 2000) for _ in range(150))]
    covered = sorted({x for a, b in spans for x in range(a, b)})
    want = [(a, b + 1) for a, b in zip([x for x in covered if x - 1 not in set(covered)], [x for x in covered if x + 1 not in set(covered)], strict=True)]
    rows = spark.createDataFrame(spans, "start long, end long")
    for block in (64, 1 << 20):
        assert sorted(map(tuple, kv.coalesce_extents(rows, block).select("start", "end").collect())) == want
    served = kv.first_fit(spark.createDataFrame([(100, 500)], "start long, end long"), spark.sql("SELECT * FROM VALUES (0, 50), (1, 50), (2, 999) AS t(seq, count)"))
    assert sorted(map(tuple, served.collect())) == [(0, 100), (1, 150), (2, None)]


def test_sample_log(spark):
    log = [(-5, "i", 1, 35432), (-4, "i", 3, 236564), (-3, "i", 7, 256523), (-2, "i", 13, 1344), (-1, "i", 14, 938243)]
    log += [(1, "s", 1, None), (2, "s", 14, None), (3, "i", 4, 32543), (4, "s", 3, None), (5, "d", 7, None), (6, "u", 3, 34653)]
    rows = spark.createDataFrame(log, "seq long, op string, key long, ptr long")
    assert sorted(map(tuple, oplog.final_state(rows).collect())) == [(1, 35432), (3, 34653), (4, 32543), (13, 1344), (14, 938243)]


def test_cache_simulation():
    gone = []
    cache = traces.MultiQueue(128, on_evict=lambda key, value: gone.append((key, value)))
    for k in range(1024):
        cache.put(k, k << 16)
    assert gone == [(k, k << 16) for k in range(896)] and sum(e == "evict" for e, _ in cache.events) == 896
    assert all(cache.get(k) == k << 16 for k in range(896, 1024))
    assert len(cache.history) == 256 and cache.get(5) is None and cache.get(6, 1) == 1


def test_cache_levels():
    cache = traces.MultiQueue(128, life=1000)
    for k in range(64):
        cache.put(k, k)
    assert [cache.get(k) for k in range(64)] == list(range(64)) and len(cache.queues[1]) == 64
    for k in range(64):
        cache.get(k), cache.get(k)
    assert len(cache.queues[2]) == 64
    for k in range(64, 128):
        cache.put(k, k)
    assert len(cache.queues[0]) == len(cache.queues[2]) == 64


def test_cache_expiry():
    cache = traces.MultiQueue(8, life=2)
    cache.put("a", 1)
    cache.get("a"), cache.get("a")
    assert cache.level["a"] == 1
    for _ in range(3):
        assert cache.get("none") is None
    cache.put("b", 2)
    assert cache.level == {"a": 0, "b": 0} and not cache.history
    for _ in range(5):
        cache.get("none")
    cache.put("c", 3)
    assert dict(cache.history) == {"b": 1} and set(cache.values) == {"a", "c"}
    cache.put("b", 4)
    assert cache.events[-2:] == [("history", "b"), ("evict", "a")] and dict(cache.history) == {"b": 1, "a": 3}


def test_varint(spark):
    rng = random.Random(4)
    numbers = [0, -1, 1, 63, -64, 64, 900, -900, 2**63 - 1, -(2**63)] + [rng.getrandbits(n) - (1 << n - 1) for n in range(1, 64) for _ in range(4)]

    def plain(v):
        z, out = (v << 1) ^ (v >> 63), bytearray()
        while z > 127:
            out.append(z & 127 | 128)
            z >>= 7
        return bytes([*out, z])

    rows = spark.createDataFrame([(v,) for v in numbers] + [(None,)], "v long").select("v", codecs.varint_encode("v").alias("e"))
    for r in rows.select("v", "e", codecs.varint_decode("e").alias("d")).collect():
        assert r.d == r.v and (r.v is None or bytes(r.e) == plain(r.v))


@given(st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([b"abcd", b"xyz", b"\0" * 40]), max_size=60).map(b"".join)))
def test_lz4(data):
    block = codecs.lz4_compress(data)
    assert codecs.lz4_decompress(block) == data and len(block) <= codecs.lz4_bound(len(data))


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 20), max_size=200))
def test_wkdm(words):
    assert codecs.wkdm_unpack(codecs.wkdm_pack(words)) == words
