from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.sources.datasource import BinaryTables
from larkspur.sources.definitions import parse_definition, resolve
from larkspur.sources.options import Manifest, export_keys, parse_connection, read_keys
from larkspur.sources.writer import Part, write_table

DBD = """COLUMNS
int ID
string Name
int Value
uint Wide

LAYOUT 000000AA
BUILD 1.0.0.1
$noninline,id$ID<32>
Name
Value<32>
Wide<u64>
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    spark.dataSource.register(BinaryTables)
    at = tmp_path_factory.mktemp("tables")
    (at / "Things.dbd").write_text(DBD)
    fields = list(resolve("Things", parse_definition(DBD), "1.0.0.1").fields)
    parts = [Part([101, 102, 103], [["a", 20, 1], ["b", 30, 2**64 - 1], ["", 20, 0]], copies={200: 102}), Part([7], [["z", -1, 5]])]
    (at / "things.DB2").write_bytes(write_table(fields, parts, layout_hash=0xAA))
    return str(at)


def load(spark, folder, **options):
    return spark.read.format("binary-table").options(path=folder, table="Things", definitions=folder, version="1.0.0.1", **options).load()


def test_scan(spark, folder):
    rows = [tuple(r) for r in load(spark, folder, file_order="true").orderBy("_section", "_row").collect()]
    assert rows == [(101, "a", 20, 1, 0, 0), (102, "b", 30, 2**64 - 1, 0, 1), (103, "", 20, 0, 0, 2), (7, "z", -1, 5, 1, 0)]


def test_id_filters_reach_the_reader(spark, folder):
    df = load(spark, folder, resolve_copies="true")
    assert [r.Name for r in df.where("ID = 102").collect()] == ["b"]
    assert [(r.ID, r.Name) for r in df.where("ID = 200").collect()] == [(200, "b")]
    assert sorted(r.ID for r in df.where(F.col("ID").isin(7, 101, 999)).collect()) == [7, 101]
    assert load(spark, folder).where("ID = 200").count() == 0
    assert sorted(r.ID for r in df.where("Value = 20").collect()) == [101, 103]


def test_equality_of_other_columns_is_exact(spark, folder):
    df = load(spark, folder, resolve_copies="true")
    plan = lambda where: df.where(where)._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan("Value = 20 AND Name = 'a'") and "Filter (" in plan("Value > 20")
    assert [r.ID for r in df.where("Value = 20 AND Name = 'a'").collect()] == [101]
    assert sorted(r.ID for r in df.where(F.col("Name").isin("a", "", "q")).collect()) == [101, 103]
    assert sorted(r.ID for r in df.where("Value IN (20, -1) AND Value = 20").collect()) == [101, 103]
    assert [r.ID for r in df.where("ID = 200 AND Value = 30").collect()] == [200] and df.where("ID = 200 AND Value = 31").count() == 0
    assert [r.ID for r in df.where("Wide = 5").collect()] == [7] and df.where("Value > 25").count() == 1


def test_columns_and_partitions(spark, folder):
    df = load(spark, folder, columns="value,ID", rows_per_partition="2")
    assert df.columns == ["Value", "ID"] and df.count() == 4 and df.rdd.getNumPartitions() == 3


def test_layout_is_checked(spark, folder, tmp_path):
    for name, text in (("Things.dbd", DBD.replace("000000AA", "000000BB")),):
        (tmp_path / name).write_text(text)
    (tmp_path / "Things.db2").write_bytes(open(f"{folder}/things.DB2", "rb").read())
    with pytest.raises(Exception, match="layout"):
        load(spark, str(tmp_path)).collect()
    assert load(spark, str(tmp_path), validate="false").count() == 4


def test_round_trip_of_a_table(spark, folder, sf, tmp_path):
    text = "COLUMNS\nint ID\nstring Name\nint Region\n\nBUILD 1.0.0.1\n$noninline,id$ID<32>\nName\nRegion<8>\n"
    (tmp_path / "Nation.dbd").write_text(text)
    fields = list(resolve("Nation", parse_definition(text), "1.0.0.1").fields)
    nation = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").collect()
    (tmp_path / "Nation.db2").write_bytes(write_table(fields, [Part([r.n_nationkey + 1 for r in nation], [[r.n_name, r.n_regionkey] for r in nation])]))
    df = spark.read.format("binary-table").options(path=str(tmp_path), table="nation", definitions=str(tmp_path), version="1.0.0.1").load()
    assert sorted((r.ID - 1, r.Name, r.Region) for r in df.collect()) == [(r.n_nationkey, r.n_name, r.n_regionkey) for r in nation]


def test_options_keys_manifest(spark, tmp_path):
    assert parse_connection("Db2Directory=/a; DbdDirectory = /b") == {"path": "/a", "definitions": "/b"}
    with pytest.raises(ValueError):
        parse_connection("What=1")
    (tmp_path / "keys").write_text("00000000000000AB 0102\n# no\n")
    assert read_keys(str(tmp_path / "keys")) == {0xAB: b"\x01\x02"}
    m = Manifest('[{"tableName": "dbfilesclient/Map.db2", "db2FileDataID": 5}, {"tableName": "Spell", "fileDataId": "9"}]')
    assert m.resolve("MAP") == 5 and m.resolve("spell.db2") == 9 and m.resolve("x") is None
    a = spark.createDataFrame([(1, b"\xbb"), (2, b"\xaa"), (3, b"\x01")], "id int, value binary")
    b = spark.createDataFrame([(1, b"\x10"), (2, b"\x20")], "id int, value binary")
    assert [r.line for r in export_keys(a, b).collect()] == ["AA 20", "BB 10"]


STORES = '''
DBD = """{dbd}"""


def store(options, table):
    return options["path"] + "/things.DB2"


def provider(options, table):
    assert table == "Things"
    return DBD


def keys(options):
    return {{}}


def decoder(content, keys):
    from larkspur.sources.format import TableFile

    return TableFile(content, keys)
'''


def test_plugged_in_stores(spark, folder, tmp_path):
    (tmp_path / "own_store.py").write_text(STORES.format(dbd=DBD))
    spark.sparkContext.addPyFile(str(tmp_path / "own_store.py"))
    own = {k: f"own_store:{k}" for k in ("store", "provider", "keys", "decoder")}
    df = spark.read.format("binary-table").options(path=folder, table="Things", version="1.0.0.1", **own).load()
    assert sorted(r.ID for r in df.collect()) == [7, 101, 102, 103]


def test_a_partition_reads_its_own_records(folder):
    from larkspur.sources.files import Source
    from larkspur.sources.format import TableFile

    path = f"{folder}/things.DB2"
    for address in (path, f"file://{path}", f"file:{path}"):
        file = TableFile(address)
        got = []
        read = Source.read
        file.source.read = lambda at, n, file=file: got.append((at, n)) or read(file.source, at, n)
        rows = file.sections[0].rows(1, 3)
        s = file.sections[0]
        assert (s.begin + file.record_size, 2 * file.record_size) in got and sum(n for _, n in got) < file.source.size / 2
        assert file.ids(rows).tolist() == [102, 103] and rows.places.tolist() == [1, 2]
