import gzip
import io
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import warc
from veilspark.llm.common import filesystem, work_dir

from .helpers import duck, named

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (5, None, "<p>one</p>"), (3, "http://a/3", None), (4, "http://a/\r\nx: y", ""), (6, "http://b/ü", "<p>ünï ❤</p>"), (7, "http://c", "WARC/1.1\r\n\r\n" * 50), (8, "u", "x" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archive_against_sql(spark):
    df = pages(spark)
    got = warc.archive(df, work_dir(spark, "t")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert named(got) == duck(warc.OP7_SQL, pages=df)


def test_payloads_come_back_and_small_ones_all_respond(spark):
    got = {r.page_id: r for r in warc.archive(pages(spark), work_dir(spark, "t"), least=11).collect()}
    assert all(r.record_type == "response" for r in got.values())
    assert {i: r.payload.decode() for i, r in got.items()} == {i: h or "" for i, _, h in PAGES}


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "u", "same"), (None, "u", "same"), (9, "u", "same"), (9, "u", "same"), (2, None, None)]
    got = warc.archive(pages(spark, rows), work_dir(spark, "t")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("2", "response", None), ("9", "response", None), ("9", "response", None), ("None", "revisit", 9), ("None", "revisit", 9)]
    assert warc.archive(pages(spark, []), work_dir(spark, "t")).collect() == []


def test_one_member_becomes_one_a_record(spark):
    folder = work_dir(spark, "t")
    made = warc.write_monolithic(warc.with_revisits(pages(spark)), f"{folder}/raw")
    warc.normalise(made, f"{folder}/raw", f"{folder}/warc")
    fs, root = filesystem(folder)
    for name in [r.file for r in made.collect()]:
        raw, normal = (fs.open_input_file(f"{root}/{d}/{name}").read() for d in ("raw", "warc"))
        z = zlib.decompressobj(31)
        z.decompress(raw)
        assert z.eof and not z.unused_data  # a single member
        assert gzip.decompress(raw) == gzip.decompress(normal)
        index = fs.open_input_file(f"{root}/warc/{name}.cdxj").read().splitlines()
        assert len(index) == len(list(warc.records(io.BytesIO(normal))))


def test_a_cut_archive_is_an_error():
    whole = gzip.compress(warc.page_record(1, "u", b"x" * 1000, None, None, False))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(whole[:-9])))
    assert len(list(warc.records(io.BytesIO(whole + whole)))) == 2


def test_a_record_that_inflates_a_thousandfold_comes_in_pieces():
    record = warc.page_record("1", "u", b"x" * 1_000_000, None, None, False)
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    whole = b"".join([*(z.compress(record) for _ in range(40)), z.flush()])
    assert len(whole) < 100_000 and max(map(len, warc.inflated(io.BytesIO(whole)))) <= warc.READ
    tracemalloc.start()
    assert sum(1 for _ in warc.records(io.BytesIO(whole))) == 40
    assert tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("size", [1, 3, 17, 1 << 20])
def test_inflated_whatever_is_read_at_once(monkeypatch, size):
    monkeypatch.setattr(warc, "READ", size)
    data = [b"", b"a" * 5000, bytes(range(256)) * 20]
    assert b"".join(warc.inflated(io.BytesIO(b"".join(map(gzip.compress, data))))) == b"".join(data)
    assert list(warc.inflated(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(gzip.compress(b"some text")[:-5])))


def test_ids_of_any_type_and_clashing_columns(spark):
    rows = [("a/b c", "u", "same", 1), ("None", "u", "same", 1), (None, "u", "same", 1), ("", "u", "other", 1), ("ü%", "u", "other", 1), ("x", None, None, 1)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string, payload long").withColumns({c: F.lit(c) for c in ("first", "n", "revisit", "__sha1", "file")})
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(df, work_dir(spark, "t")).collect()}
    assert got == {"a/b c": ("response", None), "None": ("revisit", "a/b c"), None: ("revisit", "a/b c"), "ü%": ("response", None), "": ("revisit", "ü%"), "x": ("response", None)}


def test_a_second_attempt_in_another_order_counts_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50)  # a file holds a few pages
    folder = work_dir(spark, "t")
    df = warc.with_revisits(spark.createDataFrame([(i, "u", f"page {i} " * 5) for i in range(40)], "page_id long, url string, html string").coalesce(1))
    warc.write_monolithic(df, f"{folder}/raw")  # what a lost attempt left
    made = warc.write_monolithic(df.orderBy(F.desc("page_id")).coalesce(1), f"{folder}/raw")
    warc.normalise(made, f"{folder}/raw", f"{folder}/warc")
    got = sorted(int(r.page_id) for r in warc.read_members(spark, f"{folder}/warc").collect())
    assert got == list(range(40))
