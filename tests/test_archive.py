from __future__ import annotations

import hashlib
import json
import struct

import pytest

from larkspur.sources import archive as a
from larkspur.sources.datasource import BinaryTables
from larkspur.sources.definitions import parse_definition, resolve
from larkspur.sources.writer import Part, write_table

KEY = lambda n: hashlib.md5(str(n).encode()).digest()
DBD = "COLUMNS\nint ID\nstring Name\n\nBUILD 1.0.0.1\n$noninline,id$ID<32>\nName\n"


def index_file(bucket: int, rows: list[tuple[bytes, int, int, int]]) -> bytes:
    body = b"".join(k[:9] + ((archive << 30) | offset).to_bytes(5, "big") + struct.pack("<I", size) for k, archive, offset, size in sorted(rows))
    return struct.pack("<2IH2B4BQ8xII", 0x10, 0, 7, bucket, 0, 4, 5, 9, 30, 1 << 40, len(body), 0) + body


def encoding_file(rows: dict[bytes, list[bytes]]) -> bytes:
    page = b"".join(bytes([len(e)]) + bytes(5) + c + b"".join(e) for c, e in rows.items()).ljust(1024, b"\0")
    return b"EN" + struct.pack(">3B2H2IBI", 1, 16, 16, 1, 1, 1, 0, 0, 3) + b"n\0\0" + bytes(32) + page


def root_file(blocks: list[tuple[int, int, list[tuple[int, bytes]]]], kind: int) -> bytes:
    out = b"TSFM" + (struct.pack("<5I", 24, kind, 9, 0, 0) if kind else struct.pack("<2I", 9, 0))
    for flags, locale, rows in blocks:
        out += struct.pack("<I", len(rows))
        out += struct.pack("<3IB", locale, flags, 0, 0) if kind == 2 else struct.pack("<2I", flags, locale)
        last = -1
        for i, _ in rows:
            out += struct.pack("<i", i - last - 1)
            last = i
        out += b"".join(k for _, k in rows) + (b"" if flags & a.NO_NAMES else bytes(8 * len(rows)))
    return out


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_root_ranks(kind):
    data = root_file([(a.IS_ENCRYPTED | 8, 2, [(5, KEY(1)), (9, KEY(2))]), (a.NO_NAMES, 4, [(5, KEY(3))]), (8, 2, [(5, KEY(4)), (7, KEY(5))]), (8, 2, [(5, KEY(6))])], kind)
    want = {5: KEY(4), 7: KEY(5), 9: KEY(2)}
    assert a.read_root(data) == want
    assert a.read_root(b"ABCD" + struct.pack("<I", 3) + b"xyz" + b"MFST" + struct.pack("<I", len(data)) + data) == want
    with pytest.raises(a.ArchiveError):
        a.read_root(b"TVFS" + bytes(20))


def test_small_files():
    assert a.read_build_info("Branch!STRING:0|Product!STRING:0|Build Key!HEX:16\neu|wow|abc\nus|wowt|def\n")[1] == {"Branch": "us", "Product": "wowt", "Build Key": "def"}
    assert a.read_build_config("# x\nroot = aa\nencoding = bb cc\n\n")["encoding"] == ["bb", "cc"]
    names = ["0000000001.idx", "0000000003.idx", "0f0000000a.idx", "x.idx"]
    assert a.active_indexes(names, []) == {0: "0000000003.idx", 15: "0f0000000a.idx"} and a.active_indexes(names, [1] + [0] * 15)[0] == "0000000001.idx"
    assert a.read_shared_versions(struct.pack("<2I", 4, 0x108 + 64) + bytes(0x100) + struct.pack("<16I", *range(16))) == list(range(16))
    enc = a.read_encoding(encoding_file({KEY(1): [KEY(2), KEY(3)], KEY(4): [KEY(5)]}))
    assert enc.find(KEY(1)) == [KEY(2), KEY(3)] and enc.find(KEY(4)) == [KEY(5)] and enc.find(KEY(9)) == []


@pytest.fixture
def store(tmp_path):
    fields = list(resolve("Things", parse_definition(DBD), "1.0.0.1").fields)
    table = write_table(fields, [Part([4, 8], [["four"], ["eight"]])])
    root, enc = root_file([(8, 2, [(77, KEY("content"))])], 2), encoding_file({KEY("content"): [KEY("gone"), KEY("table")], KEY("root"): [KEY("root-e")]})
    data, rows = b"", {b: [] for b in range(16)}
    for n, (name, body) in enumerate((("table", table), ("root-e", root), ("enc-e", enc))):
        block = b"BLTE" + bytes(4) + b"N" + body
        record = (bytes(0x1E) if n else b"") + block
        bucket = a.bucket_of(KEY(name))
        rows[(bucket + (n == 1)) % 16].append((KEY(name), 0, len(data), len(record)))  # one lies in the next bucket
        data += record
    config = KEY("config").hex()
    folder = tmp_path / "Data" / "data"
    folder.mkdir(parents=True)
    (folder / "data.000").write_bytes(data)
    for b, own in rows.items():
        (folder / f"{b:02x}00000001.idx").write_bytes(index_file(b, own))
    at = tmp_path / "Data" / "config" / config[:2] / config[2:4]
    at.mkdir(parents=True)
    (at / config).write_text(f"root = {KEY('root').hex()}\nencoding = {KEY('enc').hex()} {KEY('enc-e').hex()}\ninstall = 00\n")
    (tmp_path / ".build.info").write_text(f"Product!STRING:0|Build Key!HEX:16\nwow|{config}\n")
    (tmp_path / "manifest.json").write_text(json.dumps([{"tableName": "Things", "db2FileDataID": 77}]))
    (tmp_path / "Things.dbd").write_text(DBD)
    return tmp_path


def test_table_of_a_store(spark, store):
    spark.dataSource.register(BinaryTables)
    options = {"store": "archive", "install": str(store), "path": str(store), "definitions": str(store), "manifest": str(store / "manifest.json"), "version": "1.0.0.1", "table": "Things"}
    df = spark.read.format("binary-table").options(**options).load()
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [(4, "four"), (8, "eight")]
    opened = a.Archive.open(options)
    with pytest.raises(FileNotFoundError):
        opened.table("Other")
    with pytest.raises(FileNotFoundError):
        opened.file(5)
    with pytest.raises(a.ArchiveError):
        a.Archive(str(store), "other")


def test_written_stores(tmp_path):
    from larkspur.sources import store_writer as w

    rows = {w.key_of(f"c{i}"): [w.key_of(f"e{i}"), w.key_of(f"f{i}")][: 1 + i % 2] for i in range(300)}
    found = a.read_encoding(w.encoding_file(rows))
    assert len(found.pages) > 5 and all(found.find(k) == v for k, v in rows.items()) and found.find(w.key_of("none")) == [] and found.find(bytes(16)) == []
    options = w.write_store(str(tmp_path), {f"T{i}": f"content {i}".encode() * 1000 for i in range(40)})
    store = a.Archive.open(options)
    assert all(store.table(f"t{i}") == f"content {i}".encode() * 1000 for i in range(40))
