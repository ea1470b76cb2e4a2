import gzip
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.plans import corpus
from parlance.schemas import TEST_CSV
from parlance.scripted import ScriptedClient
from parlance.sources import files, folders, tables


def write(folder, name, body):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())
    return path


GOOD = {
    "plain.csv": 'id,dialogue,summary\n1,"a\nb",s\n2,c,\n',
    "other order.csv": "extra,summary,dialogue,id\nx,s,d,3\n",
    "bom.csv": "﻿id,dialogue,summary\r\n4,é,s\r\n",
    "short.csv": "id,dialogue,summary\n5,only\n",
    "mark.csv": "id,dialogue,summary\n6,�,s\n",
    "twice.csv": "id,dialogue,summary,dialogue\n7,first,s,second\n",
    "packed.csv.gz": gzip.compress(b"id,dialogue,summary\n8,gz,s\n"),
}
BAD = {
    "empty.csv": ("", "no header"),
    "lacking.csv": ("id,summary\n1,s\n", "no column dialogue"),
    "ragged.csv": ("id,dialogue,summary\n1,a,b,c\n", "a record of 4 cells under 3 columns"),
    "latin.csv": ("id,dialogue,summary\n1,é,s\n".encode("latin-1"), "not UTF-8"),
    "broken.csv.gz": (gzip.compress(os.urandom(5000))[:300], "cannot be read"),
    "wide.csv": (",".join(["id", "dialogue", "summary", *[f"x{i}" for i in range(250)]]) + "\n", "over 200 columns"),
}


def fill(folder, bad=True):
    for name, body in GOOD.items():
        write(folder, name, body)
    for name, (body, _) in BAD.items() if bad else ():
        write(folder, name, body)


def test_good_files_by_column_name(spark, folder):
    fill(folder)
    found = folders.scan(spark, folder, TEST_CSV)
    got = {(r["file_name"], r["id"], r["dialogue"], r["summary"]) for r in found.rows.collect()}
    assert got == {
        ("plain.csv", "1", "a\nb", "s"), ("plain.csv", "2", "c", None), ("other order.csv", "3", "d", "s"),
        ("bom.csv", "4", "é", "s"), ("short.csv", "5", "only", None), ("mark.csv", "6", "�", "s"),
        ("twice.csv", "7", "first", "s"), ("packed.csv.gz", "8", "gz", "s"),
    }


def test_bad_files_are_named(spark, folder):
    fill(folder)
    found = folders.scan(spark, folder, TEST_CSV)
    errors = {os.path.basename(p): e for p, e in found.errors.items()}
    assert set(errors) == set(BAD)
    assert all(errors[n].startswith(reason) for n, (_, reason) in BAD.items()), errors
    table = {r["file_name"]: (r["records"], r["error"]) for r in found.files.collect()}
    assert table["plain.csv"] == (2, None) and table["lacking.csv"] == (1, "no column dialogue") and len(table) == len(GOOD) + len(BAD)


def test_reading_one_set_names_its_bad_file(spark, folder):
    fill(folder)
    with pytest.raises(ValueError, match="lacking.csv: no column dialogue"):
        files.read_test_set(spark, folder)
    os.makedirs(folder + "/only")
    fill(folder + "/only", bad=False)
    assert files.read_test_set(spark, folder + "/only").count() == 8


def test_types_and_optional_columns(spark, folder):
    write(folder, "a.csv", "n,id\n1,x\n2,y\n")
    write(folder, "b.csv", "id\nz\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    got = sorted((r["id"], r["n"]) for r in folders.scan(spark, folder, schema, ["id"]).rows.collect())
    assert got == [("x", 1), ("y", 2), ("z", None)]


def test_own_export_is_one_file(spark, folder):
    rows = spark.createDataFrame([(str(i), f"d{i}", f"s{i}", "more") for i in range(40)], "id string, dialogue string, summary string, note string")
    tables.export_csv(rows.repartition(4), folder + "/mine.csv")
    tables.export_csv(rows.limit(0), folder + "/none.csv")
    found = folders.scan(spark, folder, TEST_CSV)
    assert found.errors == {} and {r["file_name"] for r in found.files.collect()} == {"mine.csv", "none.csv"}
    assert sorted(r["id"] for r in found.rows.where(F.col("file_name") == "mine.csv").collect()) == sorted(map(str, range(40)))


def test_no_files(spark, folder):
    found = folders.scan(spark, folder, TEST_CSV)
    assert found.rows.columns == ["file_name", "file_pos", *TEST_CSV.names]
    assert found.rows.collect() == [] and found.files.collect() == []


def test_diversity_report_tells_what_it_left_out(spark, folder):
    for name in ("one.csv", "two.csv"):
        write(folder + "/in", name, "topic,dialogue\nt,red dogs ran\nt,red dog runs\nt,blue\n")
    write(folder + "/in", "bad.csv", "topic\nx\n")
    got = corpus.diversity_report(spark, folder + "/in", ScriptedClient, folder + "/report", "r").collect()
    assert {(r["file_name"], r["metric"]) for r in got if r["error"] is None} == {(f, m) for f in ("one.csv", "two.csv") for m in ("rouge", "cosine")}
    assert [(r["file_name"], r["metric"], r["error"]) for r in got if r["error"]] == [("bad.csv", "unreadable", "no column dialogue")]
