from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from themeloom.sources import (
    check_document_count,
    nested_documents,
    read_lines,
    read_matrix,
    read_matrix_rows,
    write_matrix_rows,
    read_triplets,
    read_vector,
    save_tables,
)


def test_triplets_with_gaps_and_any_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("doc,word,count\n7,1,2\n1,3,1\n1,1,4\n7,2,1\n1,3,1\n")
    triplets = read_triplets(spark, str(tmp_path / "t.csv"))
    docs = {r["doc_id"]: [tuple(t) for t in r["terms"]] for r in nested_documents(triplets).collect()}
    assert docs == {1: [(0, 4.0), (2, 2.0)], 7: [(0, 2.0), (1, 1.0)]}
    assert check_document_count(triplets, 2) == 2
    with pytest.warns(UserWarning, match="expected 3 documents, found 2"):
        check_document_count(triplets, 3)


def test_damaged_triplets_fail(spark, tmp_path):
    (tmp_path / "t.csv").write_text("doc,word,count\n7,one,2\n")
    with pytest.raises(Exception):
        read_triplets(spark, str(tmp_path / "t.csv")).collect()


def test_json_matrix_and_vector(spark, tmp_path):
    data = {"anchors": [3, 1, 2], "inputs": {"beta": [[0.5, 0.25], [0.125, 1e-300]], "mu": [0.0, -1.5]}}
    (tmp_path / "m.json").write_text(json.dumps(data, indent=1))
    path = str(tmp_path / "m.json")
    assert [tuple(r) for r in read_vector(spark, path, "anchors").collect()] == [(0, 3.0), (1, 1.0), (2, 2.0)]
    assert [tuple(r) for r in read_vector(spark, path, "inputs.mu").collect()] == [(0, 0.0), (1, -1.5)]
    cells = [tuple(r) for r in read_matrix(spark, path, "inputs.beta").collect()]
    assert cells == [(0, 0, 0.5), (0, 1, 0.25), (1, 0, 0.125), (1, 1, 1e-300)]


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\nthree four\n")
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "", "three four"]


def test_saved_tables(spark, tmp_path):
    frame = spark.range(5).withColumn("v", F.col("id") * 1.5)
    for fmt in ("parquet", "csv", "json"):
        paths = save_tables({"t": frame}, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).schema(frame.schema).option("header", True).load(paths["t"])
        assert sorted(back.collect()) == sorted(frame.collect())
    with pytest.raises(ValueError):
        save_tables({"t": frame}, str(tmp_path / "x"), "xml")


def test_matrix_rows_in_records(spark, tmp_path):
    """Stretches of rows as records of their own; whole rows written by others are read too."""
    path = str(tmp_path / "rows")
    cells = [(i, j, i + j / 8) for i in range(3) for j in range(25) if (i + j) % 4]
    write_matrix_rows(spark.createDataFrame(cells, "i BIGINT, j BIGINT, value DOUBLE"), path, 10)
    assert spark.read.json(path).count() == 9
    assert sorted(tuple(r) for r in read_matrix_rows(spark, path).collect()) == cells
    (tmp_path / "plain.json").write_text('{"i": 1, "row": [0.5, null, 2]}\n{"i": 0, "row": []}\n')
    assert [tuple(r) for r in read_matrix_rows(spark, str(tmp_path / "plain.json")).collect()] == [(1, 0, 0.5), (1, 2, 2.0)]
