"""The splittable CSV reader against Spark's one-task reader."""

import contextlib
import os

import pytest
from conftest import rows

from textfacts.sources import tables

COLUMNS = ["id", "head\nline", "text"]
HEADER = 'id,"head\nline",text\n'
BODY = HEADER + '1,"x\ny ""q""\n\n",z\n2,,"\r\n"\n\n3,"""",é\n"4","",\\N\n5,plain,"日\n\n\n,"",\n"'
LONG = HEADER + '1,"' + "\n".join(f'line {k}, ""w""' for k in range(200)) + '",end\n2,b,c\n'


@contextlib.contextmanager
def split_size(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(folder, **files):
    os.makedirs(folder)
    for name, body in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", newline="") as out:
            out.write(body)
    return folder


def both(spark, path, columns=COLUMNS):
    return [sorted(map(str, rows(read(spark, path, columns)))) for read in (tables.articles_csv, tables.articles_csv_split)]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [*range(7, 31), 64, 1000])
def test_cuts_at_every_place_give_the_same_rows(spark, fresh, size, ends):
    path = written(fresh("csv"), a=BODY.replace("\r\n", "\n").replace("\n", ends) if ends != "\n" else BODY)
    with split_size(spark, size):
        one, many = both(spark, path)
    assert many == one and len(one) == 5


def test_a_record_longer_than_several_splits_and_several_files(spark, fresh):
    path = written(fresh("csv"), a=LONG, b=BODY, c=HEADER, d=HEADER + "7,no end,of line", e=LONG.rstrip("\n"))
    with split_size(spark, 300):
        found = tables.articles_csv_split(spark, path, COLUMNS)
        one, many = both(spark, path)
    assert many == one and len(one) == 5 + 2 + 2 + 1
    assert sum(r["text"] == "end" for r in found.collect()) == 2


def test_a_large_file_is_read_by_many_tasks(spark, fresh):
    path = written(fresh("csv"), a=HEADER + "".join(f'{k},"a\nb",{k}\n' for k in range(3000)))
    with split_size(spark, 2000):
        from textfacts.sources.records import _lines

        assert _lines(spark, path).rdd.getNumPartitions() >= 15
        got = rows(tables.articles_csv_split(spark, path, COLUMNS))
    assert sorted(got) == sorted((str(k), "a\nb", str(k)) for k in range(3000))


def test_text_is_not_shuffled(spark, fresh):
    path = written(fresh("csv"), a=BODY)
    shown = tables.articles_csv_split(spark, path, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(value" not in shown and "hashpartitioning(record" not in shown
    assert "CartesianProduct" not in shown


def test_written_articles_come_back(spark, fresh):
    texts = [("1", 'a "b"\r\nc', None), ("2", "", "\n\n"), ("3", ' , ""', "é\\"), (None, "\\n", '"')]
    df = spark.createDataFrame(texts, "id string, `head\nline` string, text string")
    tables.write_articles_csv(df, fresh("out"))
    with split_size(spark, 40):
        assert sorted(map(str, rows(tables.articles_csv_split(spark, fresh("out"), COLUMNS)))) == sorted(map(str, texts))


def test_another_header_is_refused(spark, fresh):
    path = written(fresh("csv"), a=BODY)
    with pytest.raises(Exception, match="header"):
        tables.articles_csv_split(spark, path, ["id", "other", "text"]).collect()


def test_empty_file(spark, fresh):
    assert rows(tables.articles_csv_split(spark, written(fresh("csv"), a=HEADER), COLUMNS)) == []
