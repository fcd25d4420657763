"""Vector files: headers by place, byte ranges, compressed files."""

import gzip

import pytest

from quillmill.sources.readers import scan_vectors
from quillmill.sources.vectorfiles import vector_lines


@pytest.fixture
def folder(tmp_path):
    """Three files; the words are numbers and their vectors one number, so lines look like headers."""
    (tmp_path / "a.vec").write_text("3 1\n7 1\n3 1\n\u00e9 5\n")
    (tmp_path / "b.vec").write_text("x 2.5\n9 1")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.vec").write_text("")
    with gzip.open(tmp_path / "c.vec.gz", "wt") as file:
        file.write("1 1\nzip 4\n")
    return tmp_path


LINES = ["7 1", "3 1", "\u00e9 5", "x 2.5", "9 1", "zip 4"]


def test_every_range_gives_each_line_once(spark, folder):
    for size in (1, 2, 3, 5, 8, 1000):
        found = [r.value for r in vector_lines(spark, str(folder), size).collect()]
        assert sorted(found) == sorted(LINES), size
    assert vector_lines(spark, str(folder), 5).rdd.getNumPartitions() > 5


def test_paths(spark, folder):
    assert [r.value for r in vector_lines(spark, f"{folder}/b.vec").collect()] == LINES[3:5]
    assert sorted(r.value for r in vector_lines(spark, f"file:{folder}/?.vec").collect()) == sorted(LINES[:5])
    assert vector_lines(spark, f"{folder}/empty.vec").count() == 0
    with pytest.raises(Exception, match="nothing.vec"):
        vector_lines(spark, f"{folder}/nothing.vec").count()


def test_numeric_words_survive(spark, folder):
    rows = {(r.word, *r.vector) for r in scan_vectors(spark, str(folder), form="text").collect()}
    assert rows == {("7", 1.0), ("3", 1.0), ("\u00e9", 5.0), ("x", 2.5), ("9", 1.0), ("zip", 4.0)}
