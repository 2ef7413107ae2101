"""The queries of files over tables that are folders of files."""

import os

from graphloom.queries import QUERIES
from graphloom.sources import scan


def folder(path):
    """A folder of tables: one of three files, and one that is a file."""
    os.makedirs(path / "documents.parquet")
    for name in ("part-0.parquet", "part-1.parquet", "part-2.parquet"):
        (path / "documents.parquet" / name).write_bytes(b"PAR1 some PAR1")
    (path / "documents.parquet" / "_SUCCESS").write_bytes(b"")
    (path / "documents.parquet" / ".part-0.parquet.crc").write_bytes(b"crc")
    (path / "orders.parquet").write_bytes(b"PAR1 other PAR1")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_read_source_has_a_row_for_each_table(spark, tmp_path):
    path = folder(tmp_path / "t")
    assert rows(QUERIES["read_source"](spark, path)) == [("documents.parquet", "PAR1", "PAR1"), ("orders.parquet", "PAR1", "PAR1")]
    (tmp_path / "t" / "documents.parquet" / "part-1.parquet").write_bytes(b"PAR1 cut")
    assert ("documents.parquet", "PAR1", " cut") in rows(QUERIES["read_source"](spark, path))


def test_contents_are_handed_on_in_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "t")
    monkeypatch.setattr(scan, "BATCH_BYTES", 20)
    got = rows(scan.scan(spark, path, "", [".parquet"]).select("rel_path", "content"))
    assert [(p, bytes(c)) for p, c in got] == [(f"documents.parquet/part-{i}.parquet", b"PAR1 some PAR1") for i in range(3)] + [("orders.parquet", b"PAR1 other PAR1")]


def test_a_file_larger_than_a_value_is_read_in_pieces(spark, tmp_path):
    path = folder(tmp_path / "t")
    with open(tmp_path / "t" / "lineitem.parquet", "wb") as f:  # holes take no disk
        f.write(b"PAR1")
        f.seek((2 << 30) + 7)
        f.write(b"PAR1")
    want = [f"{t}.parquet" for t in ("documents", "lineitem", "orders")]
    assert rows(QUERIES["read_source"](spark, path)) == [(t, "PAR1", "PAR1") for t in want]
    assert rows(QUERIES["scan_files"](spark, path)) == [(f"data:{t}", t, "parquet") for t in want]


def test_pieces_join_to_the_file(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "t")
    want = {r["rel_path"]: bytes(r["content"]) for r in scan.scan(spark, path).collect()}
    for size in (1, 3, 4, 14, 1000):
        monkeypatch.setattr(scan, "PIECE_BYTES", size)
        got = {}
        for r in scan.scan_pieces(spark, path).orderBy("rel_path", "at").collect():
            assert len(r["content"]) <= size and r["at"] == len(got.get(r["rel_path"], b""))
            got[r["rel_path"]] = got.get(r["rel_path"], b"") + bytes(r["content"])
        assert got == want and b"" in want.values()
        assert rows(QUERIES["read_source"](spark, path)) == [("documents.parquet", "PAR1", "PAR1"), ("orders.parquet", "PAR1", "PAR1")]


def test_scan_files_has_a_row_for_each_table(spark, tmp_path):
    path = folder(tmp_path / "t")
    assert rows(QUERIES["scan_files"](spark, path)) == [("data:documents.parquet", "documents.parquet", "parquet"), ("data:orders.parquet", "orders.parquet", "parquet")]
