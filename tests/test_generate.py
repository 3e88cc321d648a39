from __future__ import annotations

import pytest

from larkspur.plans.generate import from_definitions, read_version
from larkspur.plans.registry import KeyArray, NameFilter, Reference, SharedKey
from larkspur.sources.definitions import parse_definition, resolve
from larkspur.sources.session import binary_session, composite_keys, stored_keys
from larkspur.sources.writer import Part, write_table

DEFS = {
    "Place": "COLUMNS\nint ID\nlocstring Name_lang\nint<Place::ID> ParentID\nint<Thing::ID> ThingIDs\n\nBUILD 1.0.0.1-1.0.0.9\n$noninline,id$ID<32>\nName_lang\nParentID<u16>\nThingIDs<32>[3]\n",
    "Thing": "COLUMNS\nint<Place::ID> ID\nstring Label\n\nBUILD 1.0.0.2\n$id$ID<32>\nLabel\n",
    "Late": "COLUMNS\nint ID\n\nBUILD 9.0.0.1\n$id$ID<32>\n",
    "Blocked": "COLUMNS\nint ID\n\nBUILD 1.0.0.2\n$id$ID<32>\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in DEFS.items():
        (tmp_path / f"{name}.dbd").write_text(text)
    place = list(resolve("Place", parse_definition(DEFS["Place"]), "1.0.0.2").fields)
    thing = list(resolve("Thing", parse_definition(DEFS["Thing"]), "1.0.0.2").fields)
    (tmp_path / "Place.db2").write_bytes(write_table(place, [Part([1, 2, 3], [["a", 0, [5, 0, 1]], ["b", 1, [0, 0, 0]], ["c", 9, [1, 1, 77]]], copies={8: 2})]))
    (tmp_path / "Thing.db2").write_bytes(write_table(thing, [Part([1, 5], [[1, "one"], [5, "five"]])], list_ids=False))
    return tmp_path


def test_entities_from_definitions(folder, caplog):
    r = from_definitions(str(folder), "1.0.0.2", NameFilter(["!blocked"]))
    assert sorted(r.entities) == ["Place", "Thing"]
    assert r["Place"].columns == {"Id": "ID", "Name": "Name_lang", "ParentID": "ParentID", "ThingIDs": "ThingIDs"}
    assert r["Place"].navigations == {"Parent": Reference("Place", "ParentID", sentinel=0), "ThingIDsCollection": KeyArray("Thing", "ThingIDs", sentinel=0)}
    assert r["Thing"].navigations == {"Place": SharedKey("Place")}
    assert not from_definitions(str(folder), "0.1.0.0").entities and "no entity" in caplog.text


def test_binary_session(spark, folder):
    s = binary_session(spark, f"Db2Directory={folder};DbdDirectory={folder};Version=1.0.0.2", filters=NameFilter(["!blocked"]))
    arrays = next(n for n, v in s.registry["Place"].navigations.items() if isinstance(v, KeyArray))
    rows = {r.Id: r for r in s.table("Place").include("Parent").include(arrays).to_df().collect()}
    assert {i: (r.Parent and r.Parent.Name, [t.Label for t in r[arrays]]) for i, r in rows.items()} == {1: (None, ["five", "one"]), 2: ("a", []), 3: (None, ["one", "one"])}
    assert s.find("Place", 8).Name == "b" and s.table("Place").count() == 3
    assert [r.Label for r in s.table("Thing").where(lambda x: x["Place.Name"] == "a").to_list()] == ["one"]
    with pytest.raises(ValueError):
        binary_session(spark, {"path": "x", "definitions": "y"})


def test_settings_and_keys(spark, tmp_path):
    (tmp_path / ".env").write_text("# x\nGAME_VERSION=1.2.3.4\n")
    assert read_version(str(tmp_path / ".env")) == "1.2.3.4"
    a = spark.createDataFrame([(1, [1, 0, 0, 0, 0, 0, 0, 0]), (2, [2] * 8)], "ID int, L array<smallint>")
    b = spark.createDataFrame([(1, [255] * 16)], "ID int, K array<smallint>")
    assert stored_keys(a, b) == {1: b"\xff" * 16}
    assert composite_keys({1: b"a"}, lambda: {1: b"b", 2: b"c"}) == {1: b"a", 2: b"c"}
