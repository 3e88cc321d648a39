from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as t
from larkspur.operators.errors import MoreThanOneRow, NoRows, NotSupported
from larkspur.operators.index import EqualityIndex
from larkspur.operators.query import Session
from larkspur.plans.registry import Collection, Entity, KeyArray, NameFilter, Reference, Registry, SharedKey, navigation_name, property_name, type_name
from larkspur.plans.sample_model import session as sample
from larkspur.streaming.windows import sessions, sliding, tumbling

MODEL = Registry(
    {
        "thing": Entity("thing", "Id"),
        "text": Entity("text", "Id"),
        "parent": Entity("parent", "Id", navigations={"children": Collection("child", "MapId", sentinel=0), "twin": SharedKey("twin")}, auto_include=()),
        "child": Entity("child", "Id", navigations={"parent": Reference("parent", "MapId", sentinel=0), "named": KeyArray("parent", "Others", sentinel=0)}),
        "twin": Entity("twin", "Id"),
        "renamed": Entity("thing", "key", columns={"key": "Id", "title": "Name"}),
        "empty": Entity("empty", "Id"),
    }
)
ROWS = {
    "thing": ("Id int, Name string", [(3, "c"), (1, "b"), (2, "a"), (5, "b"), (4, "a")]),
    "text": ("Id int, Name string, Prefix string", [(1, "Dire Maul", "Di"), (2, "Dalaran", "Di"), (3, "Stormwind", "St"), (4, "abc_xyz", "x"), (5, "xyz_abc", None), (6, "Xxyz", "")]),
    "parent": ("Id int", [(0,), (1,), (2,), (3,)]),
    "child": ("Id int, MapId int, Others array<int>", [(101, 1, [2, 0, 2, 99, 1]), (102, 1, []), (103, 2, None), (104, 2, [3]), (105, 999, [0]), (106, 0, [1]), (107, None, None)]),
    "twin": ("Id int, V string", [(1, "x"), (3, None)]),
    "empty": ("Id int, Name string", []),
}


@pytest.fixture(scope="module")
def s(spark):
    frames = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in ROWS.items()}
    return Session(spark, MODEL, frames.__getitem__)


def ids(q):
    return [r[0] for r in q.to_list()]


def test_ordering_and_paging(s):
    q = s.table("thing")
    assert ids(q.order_by("Name").then_by("Id").take(4)) == [2, 4, 1, 5]
    assert ids(q.order_by("Id").order_by("Name", desc=True).then_by("Id")) == [3, 1, 5, 2, 4]
    assert ids(q.order_by("Id").skip(2).take(2)) == [3, 4]
    assert ids(q.order_by("Id").skip(1).skip(2)) == [4, 5]
    assert sorted(ids(q.take(0))) == [] and sorted(ids(q.take(-3))) == [] and len(ids(q.skip(-1))) == 5
    assert q.order_by("Id").last().Id == 5 and q.order_by("Id", desc=True).last().Id == 1
    assert q.order_by("Id").take(3).last().Id == 3
    assert q.take(10).skip(2).count() == 3
    with pytest.raises(ValueError):
        q.then_by("Id")


def test_legacy_composition(s):
    old = Session(s.spark, s.registry, s.read, legacy_composition=True)
    q = old.table("thing")
    assert ids(q.take(2).where("Id > 2").order_by("Id")) == [3, 4]
    assert ids(q.order_by("Id").take(3).skip(1)) == [2, 3, 4]
    assert q.take(10).skip(2).count() == 3


def test_elements(s):
    q = s.table("thing")
    assert q.order_by("Id").first().Id == 1 and q.single("Id = 3").Name == "c" and q.first_or_none("Id = 9") is None and q.last_or_none("Id = 9") is None
    with pytest.raises(NoRows):
        q.first("Id = 9")
    with pytest.raises(NoRows):
        q.single("Id = 9")
    with pytest.raises(NoRows):
        s.table("empty").last()
    with pytest.raises(MoreThanOneRow):
        q.single("Name = 'a'")
    e = s.table("empty")
    assert e.first_or_none() is None and e.single_or_none() is None and not e.any() and e.count() == 0 and e.all("Id > 5")
    assert q.any("Id = 5") and not q.any("Id = 6") and q.all("Id > 0") and not q.all(F.when(F.col("Id") > 1, True)) and q.count("Name = 'b'") == 2


def test_strings(s):
    q = s.table("text")
    name = F.col("Name")
    assert ids(q.where(t.starts_with(name, "Dire"))) == [1] and ids(q.where(t.starts_with(name, "dire"))) == [] and ids(q.where(t.starts_with(name, "dire", True))) == [1]
    assert ids(q.where(t.contains(name, "ire"))) == [1] and ids(q.where(t.ends_with(name, "_xyz"))) == [4] and ids(q.where(t.ends_with(name, "XYZ", True))) == [4, 6]
    assert sorted(ids(q.where(t.starts_with(name, F.col("Prefix"))))) == [1, 3, 6]
    assert sorted(ids(q.where(t.is_blank(F.col("Prefix"))))) == [5, 6]


def test_lookup(s):
    assert s.find("thing", 2).Name == "a" and s.find("thing", 9) is None
    assert [r.Id for r in s.find_many("thing", [5, 1, 9, 1]).collect()] == [1, 5]
    assert [r.Id for r in s.find_many("thing", list(range(2000)), take=2).collect()] == [1, 2]
    assert s.find_many("thing", []).count() == 0 and s.find_many("thing", [1], take=0).count() == 0
    with pytest.raises(ValueError):
        s.find_many("thing", [1], take=-1)
    assert s.table("renamed").where("key = 3").single().title == "c"


def test_includes(s):
    got = {r.Id: ([c.Id for c in r.children], r.twin and r.twin.Id) for r in s.table("parent").include("children").include("twin").to_df().collect()}
    assert got == {0: ([], None), 1: ([101, 102], 1), 2: ([103, 104], None), 3: ([], 3)}
    got = {r.Id: (r.parent and r.parent.Id, [o.Id for o in r.named]) for r in s.table("child").include("parent").include("named").to_df().collect()}
    assert got == {101: (1, [2, 2, 1]), 102: (1, []), 103: (2, []), 104: (2, [3]), 105: (None, []), 106: (None, [1]), 107: (None, [])}
    deep = s.table("parent").where("Id = 2").include("children").then_include("named").single()
    assert [[o.Id for o in c.named] for c in deep.children] == [[], [3]]
    page = s.table("parent").order_by("Id", desc=True).skip(1).take(1).include("children").to_df().collect()
    assert [(r.Id, len(r.children)) for r in page] == [(2, 2)]
    assert s.table("parent").select("Id").include("children").to_df().columns == ["Id"]
    with pytest.raises(KeyError):
        s.table("parent").include("nothing")


def test_navigation_predicates(s):
    q = s.table("child")
    assert sorted(ids(q.where(lambda x: x["parent"].isNotNull() & (x["parent.Id"] == 2)))) == [103, 104]
    assert sorted(ids(q.where(lambda x: x["parent.twin.V"] == "x"))) == [101, 102]
    p = s.table("parent")
    assert sorted(ids(p.where_any("children"))) == [1, 2] and sorted(ids(p.where_none("children", F.col("Id") > 102))) == [0, 1, 3]
    assert sorted(ids(p.where(lambda x: x.count("children") == 0))) == [0, 3] and ids(p.where(lambda x: x.any("children", F.col("Id") == 104))) == [2]
    assert ids(p.order_by(lambda x: x.count("children"), desc=True).then_by("Id", desc=True).take(2)) == [2, 1]
    assert [tuple(r) for r in q.select("Id", twin=lambda x: x["parent.twin.V"]).where("twin IS NOT NULL").order_by("Id").to_list()] == [(101, "x"), (102, "x")]


def test_joins(s):
    c, p = s.table("child"), s.table("parent")
    assert sorted(ids(c.join(p.where("Id > 1"), "MapId", "Id", prefix="p_"))) == [103, 104]
    assert {r.Id: r.p_Id for r in c.left_join(p, "MapId", "Id", prefix="p_").to_list()} == {101: 1, 102: 1, 103: 2, 104: 2, 105: None, 106: 0, 107: None}
    assert c.right_join(p, "MapId", "Id", prefix="p_").count() == 6


def test_strict_mode(s):
    strict = Session(s.spark, s.registry, s.read, parity=True).table("thing")
    for f in (lambda: strict.group_by("Id"), lambda: strict.distinct(), lambda: strict.union(strict), lambda: strict.right_join(strict, "Id", "Id"), lambda: strict.reverse(), lambda: strict.sum("Id"), lambda: strict.take_while("Id > 1")):
        with pytest.raises(NotSupported):
            f()
    with pytest.raises(NotSupported):
        strict.save()


def test_beyond_the_core_set(s):
    q = s.table("thing")
    assert ids(q.order_by("Id").take_while("Id < 3")) == [1, 2] and sorted(ids(q.order_by("Id").skip_while("Id < 3"))) == [3, 4, 5]
    assert ids(q.reverse().take(2)) == [5, 4] and q.element_at(1).first().Id == 2 and q.sum("Id").first()[0] == 15
    assert s.table("empty").default_if_empty().to_df().collect()[0].Id is None and q.default_if_empty().count() == 5
    assert q.contains("Name", "c") and not q.contains("Name", "z")


def test_registry_checks():
    with pytest.raises(ValueError):
        Registry({"a": Entity("a", "")})
    with pytest.raises(ValueError):
        Registry({"a": Entity("a", "Id", navigations={"b": Reference("b", "x")})})
    with pytest.raises(ValueError):
        Registry({"a": Entity("a", "Id", auto_include=("x",))})
    assert MODEL["THING"].table == "thing"
    taken: set[str] = set()
    assert [property_name(n, taken) for n in ("Name_lang", "map_id", "Field_1_2", "Name", "3d")] == ["Name", "MapId", "Field_1_2", "Name2", "_3d"]
    assert type_name("a-b c") == "a__b__u0020__c" and navigation_name("MapID", False, set()) == "Map" and navigation_name("Map", True, {"Map"}) == "MapCollection"
    f = NameFilter(["!^Spell", "~^SpellName$", "# no"])
    assert f.takes("Map") and not f.takes("spell") and f.takes("SpellName")


def test_equality_index(s, spark, tmp_path):
    df = spark.createDataFrame([(101, 20), (102, 30), (103, 20), (104, None)], "Id int, V int")
    index = EqualityIndex.build(df, "t", "V", ["Id"], "1.0", path=str(tmp_path))
    find = lambda i: sorted(r.Id for r in i.find(df, 20).collect())
    assert find(index) == [101, 103] and sorted(r.Id for r in index.find_range(df, 20, 30).collect()) == [101, 102, 103]
    assert index.find(df, 21).count() == 0
    for stale in ({"version": "2.0"}, {"layout": "x"}, {"path": str(tmp_path / "gone")}):
        assert find(EqualityIndex(**{**index.__dict__, **stale})) == [101, 103]


def test_an_index_narrows_the_scan(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id AS Id", "id % 1000 AS V").coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    index = EqualityIndex.build(df, "t", "V", ["Id"], "1.0", path=str(tmp_path))
    plan = index.find(df, 7)._jdf.queryExecution().toString()
    assert "In(Id, [" in plan and "EqualTo(V,7)" in plan and "Join" not in plan and "Exchange" not in plan
    assert sorted(r.Id for r in index.find(df, 7).collect()) == [7, 1007, 2007, 3007, 4007]
    monkeypatch.setattr("larkspur.operators.index.MOST_KEYS", 3)
    plan = index.find(df, 7)._jdf.queryExecution().toString()
    assert "In(Id" not in plan and "EqualTo(V,7)" in plan and index.find(df, 7).count() == 5


def test_windows_of_places(s):
    q = s.table("thing").order_by("Id")
    for ops in ([("skip", 1), ("take", 2)], [("take", 3), ("skip", 1)], [("take", 2), ("skip", 5)], [("skip", 2), ("skip", 1)], [("skip", 9)], [("take", 4), ("skip", 1), ("take", 2), ("skip", 1)], [("skip", 0)]):
        want, got = [1, 2, 3, 4, 5], q
        for op, n in ops:
            want, got = (want[n:] if op == "skip" else want[:n]), getattr(got, op)(n)
        assert ids(got) == want and got.count() == len(want) and got.any() == bool(want), ops
    assert ids(q.take(3).where("Id > 1").skip(1)) == [3] and q.skip(1).take(2).sum("Id").first()[0] == 5
    assert sorted(ids(q.skip(1).take(3).order_by("Name"))) == [2, 3, 4]


def test_skipping_with_nulls_and_ties(spark):
    rows = [(None, 1), (None, 2), (3, 3), (3, 3), (3, 3), (1, 4), (5, None)]
    own = Session(spark, Registry({"t": Entity("t", "b", order=("b",))}), lambda _: spark.createDataFrame(rows, "a int, b int"))
    least = lambda v: (v is not None, v or 0)
    for desc in (False, True):
        order = sorted(sorted(rows, key=lambda r: least(r[1])), key=lambda r: least(r[0]), reverse=desc)
        for n in range(9):
            got = own.table("t").order_by("a", desc=desc).skip(n).to_df().collect()
            assert sorted(map(tuple, got), key=str) == sorted(order[n:], key=str), (desc, n)
        for stop in (F.col("a") != 3, F.col("a").isNull(), F.lit(True), F.lit(False)):
            assert own.table("t").order_by("a", desc=desc).take_while(stop).count() + own.table("t").order_by("a", desc=desc).skip_while(stop).count() == 7


def test_keys_of_joins(s):
    c, p = s.table("child"), s.table("parent")
    assert sorted(ids(c.join(p, F.col("MapId") * 1, lambda x: x["Id"], prefix="p_"))) == [101, 102, 103, 104, 106]
    assert sorted(ids(c.join(c, ["Id", "MapId"], ["Id", "MapId"], prefix="o_", hint="merge"))) == [101, 102, 103, 104, 105, 106]
    assert sorted(ids(c.join(p, [lambda x: x["parent.twin.Id"]], ["Id"], prefix="p_"))) == [101, 102]
    with pytest.raises(ValueError):
        c.join(p, ["Id"], ["Id", "Id"])
    assert p.cross_join(p, "o_").count() == 16 and p.join_where(p, lambda a, b: a("Id") < b("Id"), prefix="o_").count() == 6


def test_as_of_and_range_joins_against_plain_versions(spark):
    import random

    r = random.Random(2)
    left = [(i, r.choice("ab") if r.random() < 0.95 else None, r.randint(0, 40) if r.random() < 0.95 else None) for i in range(150)]
    right = [(r.choice("abc") if r.random() < 0.95 else None, r.randint(0, 40) if r.random() < 0.95 else None, i) for i in range(60)]
    own = Session(spark, Registry({}), lambda _: None)
    a, b = own.of(spark.createDataFrame(left, "id int, k string, t int")), own.of(spark.createDataFrame(right, "k string, t int, v int"))
    want = {}
    for i, k, t in left:
        fits = [(u, v) for j, u, v in right if j is not None and j == k and u is not None and t is not None and u <= t]
        want[i] = max(fits)[1] if fits else None
    for width in (None, 5, 1000):
        got = a.join_as_of(b, "t", "t", {"k": "k"}, prefix="r_", width=width).to_df()
        assert {x.id: x.r_v for x in got.collect()} == want, width
    ranges = own.of(spark.createDataFrame([(1, 5, "x"), (4, 30, "y"), (9, 2, "none"), (None, 7, "z"), (40, 40, "w")], "low int, high int, name string"))
    pairs = sorted((i, n) for i, _, t in left if t is not None for lo, hi, n in [(1, 5, "x"), (4, 30, "y"), (40, 40, "w")] if lo <= t <= hi)
    for width in (3, 100):
        assert sorted((x.id, x.name) for x in a.join_range(ranges, "t", "low", "high", width).to_df().collect()) == pairs
    assert a.join_range(ranges, "t", "low", "high", 7, how="left").count() == len(pairs) + sum(t is None or not any(lo <= t <= hi for lo, hi in ((1, 5), (4, 30), (40, 40))) for _, _, t in left)


def test_columns_of_includes(s):
    row = s.table("parent").where("Id = 2").include("children", ["MapId"]).then_include("named", ["Id"]).single()
    assert [c.asDict(True) for c in row.children] == [{"MapId": 2, "named": []}, {"MapId": 2, "named": [{"Id": 3}]}]
    eager = Session(s.spark, Registry({**MODEL.entities, "parent": Entity("parent", "Id", navigations=MODEL["parent"].navigations, auto_include=("twin",))}), s.read)
    assert eager.table("parent").where("Id = 1").single().twin.V == "x"


def test_collations(spark):
    own = Session(spark, Registry({"t": Entity("t", "id")}), lambda _: spark.createDataFrame([(1, "b"), (2, "A"), (3, "a"), (4, "B"), (5, None)], "id int, v string"))
    assert [r.id for r in own.table("t").order_by("v", collation="UNICODE_CI").to_list()] == [5, 2, 3, 1, 4] and [r.id for r in own.table("t").order_by("v").to_list()] == [5, 2, 4, 3, 1]


def test_plans(spark, sf):
    s = sample(spark, sf)
    plan = lambda df: df._jdf.queryExecution().toString()
    p = plan(s.find_df("orders", 42).select("o_orderkey", "o_totalprice"))
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    assert "LeftSemi" in plan(s.table("customer").where_any("orders").to_df()) and "LeftAnti" in plan(s.table("customer").where_none("orders").to_df())
    assert "TakeOrderedAndProject" in plan(s.table("orders").order_by("o_totalprice").take(5).to_df())


def test_pages_are_top_k(spark, sf):
    from larkspur import queries

    for name in ("page", "flagship", "include_after_page", "element_at", "skip_cumulative", "skip_ordered", "count_after_take", "take_while", "skip_while", "default_if_empty", "equality_index"):
        p = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        whole = [x for x in p.split("\n") if "SinglePartition" in x and "SHUFFLE" not in x.upper()]
        assert "rangepartitioning" not in p and "Window" not in p, name
        if name in ("page", "flagship", "include_after_page", "element_at", "take_while", "skip_while"):
            assert "TakeOrderedAndProject" in p and not whole, (name, p)


def test_includes_narrow_before_they_aggregate(spark, sf):
    s = sample(spark, sf)
    p = s.table("customer").order_by("c_acctbal").take(5).include("orders")
    p = p.include("nation").to_df()._jdf.queryExecution().executedPlan().toString()
    assert p.count("LeftSemi") == 2 and p.index("ObjectHashAggregate") < p.index("LeftSemi")
    # The whole table needs all of them.
    assert "LeftSemi" not in s.table("customer").include("orders").to_df()._jdf.queryExecution().executedPlan().toString()


def test_streams_and_tables_share_windows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, f in (("slides", lambda df, late: sliding(df, "ts", "2 hours", "1 hour", late=late)), ("hours", lambda df, late: tumbling(df, "ts", "1 hour", "event_type", late=late)), ("gaps", lambda df, late: sessions(df, "ts", "10 minutes", "user_id", late=late))):
        q = f(stream, "1 hour").writeStream.format("memory").queryName(name).outputMode("append" if name == "gaps" else "complete").start()
        q.processAllAvailable()
        q.stop()
        got, want = {tuple(r) for r in spark.table(name).collect()}, {tuple(r) for r in f(table, None).collect()}
        assert got == want if name != "gaps" else got <= want and got
