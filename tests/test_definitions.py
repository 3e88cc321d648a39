from __future__ import annotations

import pytest

from larkspur.sources.definitions import DefinitionError, VIRTUAL_ID, VIRTUAL_RELATION, parse_column, parse_definition, parse_entry, pick_block, resolve

TEXT = """COLUMNS
int ID
locstring Name_lang // the shown name
int<Other::ID> OtherID?
float Scale
uint Mask

LAYOUT 0A0B0C0D, 01020304
BUILD 1.0.0.10, 1.0.0.20-1.0.0.30
BUILD 1.1.0.5
COMMENT anything
$noninline,id$ID<32>
Name_lang
$noninline,relation$OtherID<u16>
Scale[3]
Mask<u8>

LAYOUT FFFFFFFF
BUILD 2.0.0.1-2.0.0.9
$id$ID<32>
Name_lang
Mask<64>
"""


def test_parse():
    d = parse_definition(TEXT)
    assert list(d.columns) == ["ID", "Name_lang", "OtherID", "Scale", "Mask"]
    assert d.columns["OtherID"].reference == ("Other", "ID") and not d.columns["OtherID"].verified
    assert d.blocks[0].builds == ["1.0.0.10", "1.0.0.20-1.0.0.30", "1.1.0.5"] and d.blocks[0].layouts == (0x0A0B0C0D, 0x01020304)


def test_resolve_types_and_indexes():
    s = resolve("T", parse_definition(TEXT), "1.0.0.25")
    assert [(f.name, f.index) for f in s.fields] == [("ID", VIRTUAL_ID), ("Name_lang", 0), ("OtherID", VIRTUAL_RELATION), ("Scale", 1), ("Mask", 2)]
    assert [f.dataType.simpleString() for f in s.struct().fields] == ["int", "string", "int", "array<float>", "smallint"]
    assert s.key.name == "ID" and s.physical_columns == 3
    assert s.field("mask").name == "Mask"
    s.validate(0x01020304, 3)
    with pytest.raises(DefinitionError):
        s.validate(5, 3)
    with pytest.raises(DefinitionError):
        s.validate(0x01020304, 4)


def test_nearest_build_in_both_directions():
    d = parse_definition(TEXT)
    assert pick_block(d, "1.0.0.31").builds[-1] == "1.1.0.5"
    assert pick_block(d, "1.2.0.0") is d.blocks[1]
    assert pick_block(d, "1.2.0.0", "at_most") is d.blocks[0]
    assert pick_block(d, "1.1.0") is d.blocks[1]  # the last build of 1.1.0
    with pytest.raises(DefinitionError):
        pick_block(d, "3.0.0.0")
    with pytest.raises(DefinitionError):
        pick_block(d, "0.9.0.0", "at_most")


def test_ambiguous_and_bad_lines():
    with pytest.raises(DefinitionError):
        pick_block(parse_definition("COLUMNS\nint A\n\nBUILD 1.0.0.1\nA<32>\n\nLAYOUT 01\nBUILD 1.0.0.1\nA<8>\n"), "1.0.0.1")
    with pytest.raises(DefinitionError):
        parse_column("int")
    with pytest.raises(DefinitionError):
        parse_entry("$id $ID<32>")
    assert parse_entry("$ID,NonInline$Key<32>").mods == {"id", "noninline"}
