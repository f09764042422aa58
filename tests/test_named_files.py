"""Files of their own names: written by the tasks, no folder each."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from panelkit.queries import QUERIES, storage
from panelkit.sources import sinks


def test_write_named(spark, tmp_path):
    path, schema = tmp_path / "out", "name string, text string"
    df = spark.createDataFrame(
        [("b/2.txt", "y"), ("a.txt", "one\nline"), ("b/2.txt", "x"), ("b/2.txt", None),
         ("b/c/3.txt", "ü, \"q\"")], schema)
    for _ in range(2):  # a repeated write replaces its files
        assert sinks.write_named(df, f"file://{path}") == 3
        got = {str(f.relative_to(path)): f.read_text() for f in path.rglob("*") if f.is_file()}
        assert got == {"a.txt": "one\nline\n", "b/2.txt": "\nx\ny\n", "b/c/3.txt": "ü, \"q\"\n"}
    assert sinks.write_named(df.limit(0), str(tmp_path / "none")) == 0
    assert list((tmp_path / "none").iterdir()) == []
    with pytest.raises(Exception, match="a file needs a name"):
        sinks.write_named(spark.createDataFrame([(None, "x")], schema), str(tmp_path / "bad"))


N = 60


@pytest.mark.parametrize("name, files, rows", [
    ("named_documents", N, 10), ("note_files", N, N), ("asset_files", 2 * N, 2 * N),
    ("failure_files", N, N)])
def test_no_folder_and_move_per_file(spark, tmp_path, monkeypatch, name, files, rows):
    """The driver neither makes a folder for each file nor moves files out of them."""
    pq.write_table(pa.table({"s_suppkey": pa.array(range(N), pa.int64()), "s_name": [
        f"name {i}" for i in range(N)]}), tmp_path / "supplier.parquet")
    monkeypatch.setattr(storage, "new_folder", lambda spark, name: str(tmp_path / "written" / name))
    assert QUERIES[name](spark, str(tmp_path)).count() == rows
    written = [f for f in (tmp_path / "written").rglob("*") if f.name[0] not in "._" or f.is_dir()]
    assert len([f for f in written if f.is_file()]) == files
    assert len([f for f in written if f.is_dir()]) <= 1 + N // 10
