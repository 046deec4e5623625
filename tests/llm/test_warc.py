import hashlib
import struct

import pytest
import zstandard

from evidentia.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip_with_revisits(spark):
    big, other = "<p>equal</p>" * 200, "é" * 500
    rows = [(k, f"http://a/{k}", big) for k in range(20)] + [(100, "http://b", other), (101, None, other)]
    rows += [(200, "x\r\ny z", "tiny"), (201, "u", "tiny"), (202, "u", None), (203, "u", ""), (None, "n", big), (None, "n", "<p>own</p>" * 300)]
    rows += [(300, "r", "<i>twice</i>" * 100), (300, "r", "<i>twice</i>" * 100)]
    found = warc.round_trip(pages(spark, rows)).collect()
    assert len(found) == len(rows) and not any(r.error for r in found)
    largest = {}
    for k, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            largest[data] = max(largest.get(data, -1), -1 if k is None else k)
    expected = []
    for k, _, html in rows:
        data = (html or "").encode()
        holder = largest.get(data, -1)
        refers = holder if holder >= 0 and holder != k else None
        expected.append((k, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(expected, key=str)
    assert {bytes(r.payload).decode() for r in found if r.page_id == 19} == {big}
    assert all(r.payload is None for r in found if r.record_type == "revisit")


def test_given_pages_come_back(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    back = {r.page_id: bytes(r.payload).decode() for r in warc.round_trip(table).filter("record_type = 'response'").collect()}
    assert back == {r.page_id: r.html for r in table.collect() if r.page_id in back} and len(back) > 40


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def archive(records, dictionary=b""):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(dict_data=known, write_checksum=True)
    return warc.dictionary_frame(dictionary) + b"".join(compressor.compress(r) for r in records)


@pytest.fixture(scope="module")
def records():
    return [warc.record(k, f"http://h/{k}", f"<html>page {k} of some site</html>".encode() * 30, None, False, "2020-01-01T00:00:00Z") for k in range(60)]


def test_dictionary_is_loaded_plain_or_compressed(records):
    dictionary = zstandard.train_dictionary(2048, records).as_bytes()
    data = archive(records, dictionary)
    plain = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary + data[len(warc.dictionary_frame(dictionary)) :]
    for content in (data, plain, archive(records)):
        assert [r["page_id"] for r in warc.read_archive("f", content)] == list(range(60))


def test_frames_end_where_the_decoder_says(records):
    data = archive(records[:3]) + struct.pack("<II", 0x184D2A50, 5) + b"other" + archive([b"x" * 400_000])
    found = list(warc.frames(data))
    assert [m == warc.FRAME_MAGIC for m, _, _ in found] == [True, True, True, False, True]
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data[found[4][1] : found[4][2]]) == b"x" * 400_000


@pytest.mark.parametrize(
    "old, new",
    [(b"WARC/1.1", b"WARC/3.0"), (b"WARC-Type: response\r\n", b""), (b"page 5", b"page 6"), (b"WARC-Date", b"WARC Date"), (b"\r\n\r\n", b"\r\n"),
     (b"response\r\nWARC-Record", b"metadata\r\nWARC-Record"), (b"x-page:5", b"x-site:5")],
)
def test_a_damaged_record_is_told_and_the_others_read(records, old, new):
    assert old in records[5]
    data = archive([records[4], records[5].replace(old, new, 1), records[6]])
    found = list(warc.read_archive("f", data))
    assert [r.get("page_id") for r in found] == [4, None, 6] and found[1]["error"]


def test_wrong_lengths_and_cut_archives(records):
    longer = records[5].replace(b"Content-Length: ", b"Content-Length: 1")
    assert "error" in list(warc.read_archive("f", archive([longer])))[0]
    data = archive(records[:3])
    found = list(warc.read_archive("f", data[:-20]))
    assert [r.get("page_id") for r in found] == [0, 1, None] and "cut off" in found[2]["error"]
    assert list(warc.read_archive("f", b"not an archive"))[0]["error"]
    assert list(warc.read_archive("f", b"")) == []
