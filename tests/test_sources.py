import json
import os

from pyspark.sql import functions as F

from parlance.functions import prompts
from parlance.operators import model
from parlance.schemas import RESPONSE, TEST_CSV
from parlance.scripted import FirstWord, SecondRun
from parlance.sources import files, tables


def write(folder, name, body):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(body)
    return path


def test_topics(spark, folder):
    path = write(folder, "topics.txt", "Remote Work\n  Pets \t\n\nFood")
    got = [tuple(r) for r in files.read_topics(spark, path).orderBy("topic_pos").collect()]
    assert got == [(0, "Remote Work"), (1, "Pets"), (2, ""), (3, "Food")]


def test_seed_dialogues(spark, folder):
    rows = [{"id": "a", "dialogue": "x\ny", "summary": "s", "other": 1}, {"dialogue": "z", "summary": "t"}]
    path = write(folder, "s.jsonl", "\n".join(json.dumps(r) for r in rows))
    got = {r["dialogue"]: r["id"] for r in files.read_seed_dialogues(spark, path).collect()}
    assert got["x\ny"] == "a" and len(got["z"]) == 32


def test_csv_folder_keeps_files_and_order(spark, folder):
    write(folder, "a_one.csv", 'id,dialogue,summary\n1,"line, one\nline ""two"""," s "\n2,,t\n')
    write(folder, "b_two.csv", 'id,dialogue,summary\n3,plain,u\n')
    rows = files.read_test_set(spark, folder).orderBy("file_name", "file_pos").collect()
    assert [(r["file_name"], r["id"], r["dialogue"]) for r in rows] == [
        ("a_one.csv", "1", 'line, one\nline "two"'), ("a_one.csv", "2", None), ("b_two.csv", "3", "plain"),
    ]
    label = files.read_test_set(spark, folder).select(files.run_label("a/b-c", F.col("file_name"))).distinct().collect()
    assert sorted(r[0] for r in label) == ["a_b_c_a", "a_b_c_b"]


def test_csv_export_keeps_text(spark, folder):
    rows = [("1", ' blank "quoted", \n\nlines ', "é"), ("2", "back\\slash", None)]
    df = spark.createDataFrame(rows, TEST_CSV)
    tables.export_csv(df, folder + "/out")
    got = files.read_test_set(spark, folder + "/out").orderBy("id").select(*TEST_CSV.names).collect()
    assert [tuple(r) for r in got] == rows


def test_save_counted(spark, folder):
    table, rows = tables.save_counted(spark.range(7), folder + "/t")
    assert rows == 7 == table.count() and tables.finished(spark, folder + "/t")


def ask(df, client, path):
    return model.generate(df, "s", ["id"], prompts.question_request(F.col("t")), client, prompts.QUESTION_PARAMS, path)


def test_answers_are_asked_once(spark, folder):
    path = folder + "/store"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    ask(df.where("id = 1"), FirstWord, path)
    got = {r["id"]: r["response"].split()[0] for r in ask(df, SecondRun, path).collect()}
    assert got == {1: "first", 2: "second"}


def test_failed_requests_are_retried(spark, folder):
    class Broken(FirstWord):
        def reply(self, system, user):
            if user.endswith("b"):
                raise RuntimeError("down")
            return super().reply(system, user)

    path = folder + "/store"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    first = {r["id"]: (r["response"], r["error"]) for r in ask(df, Broken, path).collect()}
    assert first[1][1] is None and first[2] == (None, "RuntimeError: down")
    again = {r["id"]: (r["response"].split()[0], r["error"]) for r in ask(df, SecondRun, path).collect()}
    assert again == {1: ("first", None), 2: ("second", None)}
    assert spark.read.schema(RESPONSE).parquet(path).count() == 3
