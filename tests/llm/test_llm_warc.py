import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textfacts.llm import warc

SCHEMA = "page_id long, url string, html string"


def round_trip(spark, path, data, **options):
    warc.write_archives(spark.createDataFrame(data, SCHEMA).withColumn("digest", F.lit("clash")).repartition(2), path, **options)
    return warc.read_archives(spark, path)


def whole(table):
    return sorted(((r["page_id"], r["payload_bytes"], r["running_digest"], r["record_type"], r["refers_to"]) for r in table.where("last").collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_copies_become_revisits_of_the_smallest_id(spark, fresh):
    long, short = "x" * 100, "y" * 99
    data = [(5, "u", long), (3, "u", long), (9, None, long), (1, "u", short), (2, "u", short), (4, "bad\r\nurl é", "\r\n\r\nWARC/1.1\r\n\r\n")]
    assert whole(round_trip(spark, fresh("a"), data)) == [
        (1, 99, sha(short), "response", None),
        (2, 99, sha(short), "response", None),
        (3, 100, sha(long), "response", None),
        (4, 16, sha(data[-1][2]), "response", None),
        (5, 100, sha(long), "revisit", 3),
        (9, 100, sha(long), "revisit", 3),
    ]


def test_long_payloads_are_segments_with_running_digests(spark, fresh):
    text = "aé\U0001f600\r\n\r\n" * 3000
    table = round_trip(spark, fresh("a"), [(1, "u", text), (2, "u", "short")], chunk=1000)
    found = sorted((r["chunk_no"], r["chunk_bytes"], r["running_digest"], r["last"]) for r in table.where("page_id = 1").collect())
    payload, at = text.encode(), 0
    for number, size, digest, last in found:
        assert 997 <= size <= 1000 or last
        at += size
        assert digest == hashlib.sha256(payload[:at]).hexdigest()
        assert last == (number == len(found))
    assert at == len(payload) and len(found) > 20
    joined = "".join(gzip.decompress(p.read_bytes()).decode() for p in Path(fresh("a")).glob("*.gz"))
    assert joined.count("WARC-Type: continuation") == len(found) - 1
    assert joined.count("WARC-Segment-Total-Length") == 1


def test_nulls_empty_texts_and_repeated_rows(spark, fresh):
    long = "z" * 200
    data = [(None, None, None), (None, "u", long), (7, "u", long), (7, "u", long), (8, "u", ""), (9, "u", long)]
    got = whole(round_trip(spark, fresh("a"), data))
    empty = sha("")
    assert got == sorted(
        [(None, 0, empty, "response", None), (None, 200, sha(long), "response", None), (7, 200, sha(long), "response", None), (7, 200, sha(long), "response", None),
         (8, 0, empty, "response", None), (9, 200, sha(long), "revisit", 7)], key=repr)


def test_empty_table(spark, fresh):
    assert round_trip(spark, fresh("a"), []).count() == 0


def test_damage_is_noticed():
    record = next(warc.records(1, "u", "some payload", None)) + "\r\n\r\n"
    assert len(list(warc.chunks(gzip.compress(record.encode())))) == 1
    with pytest.raises(ValueError):
        list(warc.chunks(gzip.compress(record.replace("some", "sone").encode())))
    with pytest.raises(ValueError):
        list(warc.chunks(gzip.compress(record[:-9].encode())))


def test_no_page_is_cut_by_the_end_of_a_file(spark, fresh, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    data = [(i, "u", f"{i} é\r\n\r\n" * (2000 if i % 2 else 3)) for i in range(20)]
    got = whole(round_trip(spark, fresh("a"), data, chunk=1000))
    assert got == sorted(((i, len(t.encode()), sha(t), "response", None) for i, _, t in data), key=repr)
    assert len(list(Path(fresh("a")).glob("*.gz"))) > 4
