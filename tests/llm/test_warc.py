import hashlib
from collections import defaultdict

import pytest
import zstandard

from tidyledger.llm import warc

CLASHING = ("sha1", "n", "file", "copy", "first_id", "is_first", "best", "all", "payload_bytes", "path", "value", "part")


@pytest.fixture
def pages_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows], "page_id long, url string, html string, "
                                     + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)

    return make


def expected(rows):
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[html or ""].append((page_id is not None, page_id or 0, url is not None, url or ""))
    out = []
    for html, members in groups.items():
        data = html.encode()
        fact = (len(data), hashlib.sha1(data).hexdigest())
        for place, (known, page_id, *_) in enumerate(sorted(members, reverse=True)):
            page_id = page_id if known else None
            if place == 0:
                first = page_id
            revisit = place > 0 and len(data) >= 1000
            out.append((page_id, *fact, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def odd_pages():
    long, other = "<p>" + "ä lon" * 400 + "</p>", "<html>" + "other " * 300
    return [(1, "http://a/1", long), (5, "http://a/5", long), (3, None, long), (None, "http://a/n", long), (2, "u", None), (4, "u", ""),
            (6, "u", "short"), (7, "u", "short"), (7, "u", "short"), (8, "x y\r\nWARC-Type: forged\t\u0085é", other),
            (8, "x y\r\nWARC-Type: forged\t\u0085é", other), (8, "again", other), (None, None, None), (2**60 + 1, "u", "\r\n\r\n" * 400),
            (2**60 + 3, "u", "\r\n\r\n" * 400), (9, "", "x" * 999), (10, "", "x" * 999), (11, "", "é" * 500), (12, "", "é" * 500),
            (13, "u", "v" * 3_000_000)]


def test_round_trip_equals_brute_force(pages_of):
    rows = odd_pages() + [(100 + i, "http://many", "<b>copies</b>" * 100) for i in range(300)]
    assert sorted(map(tuple, warc.round_trip(pages_of(rows)).collect()), key=repr) == expected(rows)


def test_a_row_repeated_very_often(pages_of, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    rows = [(1, "u", "y" * 2000)] * 50 + [(0, "u", "y" * 2000)] * 3 + [(2, "u", "y" * 1000)] * 2
    assert sorted(map(tuple, warc.round_trip(pages_of(rows)).collect()), key=repr) == expected(rows)


def test_payloads_come_back_and_revisits_find_theirs(spark, pages_of, tmp_path):
    rows = odd_pages()
    warc.write_archives(pages_of(rows), f"file://{tmp_path}/out", archive_bytes=5000)
    found = warc.read_archives(spark, f"file://{tmp_path}/out", payloads=True).collect()
    assert len({r.archive for r in found}) > 5
    payloads = {r.record_id: r.payload for r in found if r.record_type == "response"}
    got = [(r.page_id, (payloads[r.refers_to_record] if r.refers_to_record else r.payload).decode()) for r in found]
    assert sorted(got, key=repr) == sorted(((p, h or "") for p, _, h in rows), key=repr)
    assert {r.url for r in found if r.page_id == 8} == {"x%20y%0D%0AWARC-Type:%20forged%09\u0085é", "again"}
    assert {r.url for r in found if r.page_id == 3} == {"urn:page:3"}


def test_files_are_plain_zstandard_behind_a_dictionary_frame(spark, pages_of, tmp_path):
    rows = [(i, f"http://a/{i}", f"<html><body class='page'><h1>Title {i}</h1><p>{'text of the page ' * (i % 9)}</p></body></html>")
            for i in range(600)]
    warc.write_archives(pages_of(rows).coalesce(1), f"file://{tmp_path}/out")
    files = [f for f in (tmp_path / "out").iterdir() if f.suffix == ".txt" and f.stat().st_size]
    texts, alone = [], 0
    for file in files:
        data = file.read_bytes()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and data.endswith(warc.EMPTY_FRAME.encode())
        size = int.from_bytes(data[4:8], "little")
        learned = zstandard.ZstdCompressionDict(data[8:8 + size])
        reader = zstandard.ZstdDecompressor(dict_data=learned).stream_reader(data[8 + size:], read_across_frames=True)
        texts.append(reader.read())
        alone += sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in warc.unpacked(data))
    whole = b"".join(texts)
    assert whole.count(b"WARC/1.1\r\n") == 600 and len(whole) > 3 * sum(f.stat().st_size for f in files)
    assert alone > 1.5 * sum(f.stat().st_size for f in files)  # the dictionaries pay, though they are stored too


def test_no_pages(spark, pages_of):
    assert warc.round_trip(pages_of([])).count() == 0


def test_too_few_records_for_a_dictionary():
    assert warc.built_dictionary([b"a"]) is None
    assert list(warc.unpacked(warc.archive([b"a", b"b"]))) == [b"a", b"b"]


def test_damage_is_an_error():
    data = warc.archive([b"record %d" % i * 50 for i in range(100)])
    with pytest.raises(ValueError):
        list(warc.unpacked(data[:-2]))
    with pytest.raises(ValueError):
        warc.parsed(b"HTTP/1.1 200 OK\r\n\r\n")
