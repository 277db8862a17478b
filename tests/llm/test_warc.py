"""Content-addressed WARC archive (3): records rebuilt byte by byte, payload stored once, defined cases."""

import hashlib
import re

import pytest

from pitchside.llm import warc

LONG = "<html>é" + "x" * 200


def archive(spark, tmp_path, rows, schema="page_id long, url string, html string"):
    path = f"file://{tmp_path}/warc"
    warc.write_archive(spark.createDataFrame(rows, schema), path)
    return path


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", LONG), (3, "http://b", LONG), (9, None, LONG), (4, "u", "short"), (8, "u", "short"), (2, "u", None),
            (7, "u", ""), (None, "n", LONG), (11, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99)]
    path = archive(spark, tmp_path, rows)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        r, raw = got[page_id], (html or "").encode()
        assert bytes(r.payload) == raw and r.digest == hashlib.sha256(raw).hexdigest()
    kind = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kind[3] == ("response", None) and kind[5] == kind[9] == kind[None] == ("revisit", 3)
    assert kind[4] == kind[8] == kind[2] == kind[7] == kind[13] == kind[14] == ("response", None)
    assert kind[11] == ("response", None) and kind[12] == ("revisit", 11)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    for r in warc.raw_records(spark, path).collect():
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block[length:] == b"\r\n\r\n"
        http, payload = block[:length].split(b"\r\n\r\n", 1)
        assert payload == (b"" if got[r.page_id].record_type == "revisit" else bytes(got[r.page_id].payload))


def test_repeated_rows_extra_columns_and_empty_tables(spark, tmp_path):
    path = archive(spark, tmp_path / "a", [(1, "u", LONG, "q"), (1, "u", LONG, "q"), (2, "u", LONG, "q")],
                   "page_id long, url string, html string, digest string")
    assert sorted((r.page_id, r.record_type) for r in warc.read_archive(spark, path).collect()) == [
        (1, "response"), (1, "response"), (2, "revisit")]
    empty = archive(spark, tmp_path / "b", [])
    assert warc.read_archive(spark, empty).collect() == []


def test_damaged_payload_is_refused(spark, tmp_path):
    path = archive(spark, tmp_path, [(1, "u", LONG)])
    spark.createDataFrame([(hashlib.sha256(LONG.encode()).hexdigest(), b"other")], "digest string, payload binary") \
        .write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match digest"):
        warc.read_archive(spark, path).collect()
