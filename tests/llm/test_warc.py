import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quiverlake.llm import warc_index as wi
from quiverlake.llm.shared import run_folder

PAGES = "page_id long, url string, html string, digest string, holder int, payload string, file int"


def pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "http://é", "é" * 100_000), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "<p>x</p>"), (None, "n", "only")]
    return spark.createDataFrame([(*r, "d", 1, "p", 2) for r in rows], PAGES)


@pytest.mark.parametrize("few", [0, 300_000])
def test_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(wi, "BROADCAST_HOLDERS", few)
    table, path = pages(spark), run_folder(spark, "w")
    index = wi.write_archives(table, path)
    got = wi.read_records(index, path).collect()
    rows = [(r.page_id, (r.html or "").encode()) for r in table.collect()]
    holder = {}
    for page_id, data in rows:
        holder[data] = max((x for x in (holder.get(data), page_id) if x is not None), default=None)
    want = Counter()
    for page_id, data in rows:
        again = page_id != holder[data]
        want[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", holder[data] if again else None, None if again else data] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got) == want
    one = wi.read_records(index.where("page_id = 5"), path).first()
    assert bytes(one.payload).decode() == "é" * 100_000 and one.url == "http://é"
    # The archives are plain WARC: members one after the other.
    files, folder = pa.fs.FileSystem.from_uri(path)
    raw = b"".join(gzip.decompress(files.open_input_file(f.path).read()) for f in files.get_file_info(pa.fs.FileSelector(f"{folder}/archives")))
    assert raw.count(b"WARC-Type: ") == len(rows) and b"\nX: y" not in raw


def test_payload_limit_and_nothing(spark):
    path = run_folder(spark, "w")
    assert {r.record_type for r in wi.write_archives(pages(spark), path, least=10**9).collect()} == {"response"}
    path = run_folder(spark, "w")
    index = wi.write_archives(pages(spark).limit(0), path)
    assert index.count() == 0 == wi.read_records(index, path).count()


def test_ranges_are_coalesced():
    offsets, lengths = np.array([0, 10, 500, 510, 5000]), np.array([10, 20, 10, 10, 5])
    assert wi.coalesced(offsets, lengths, 100, 10_000) == [(0, 2), (2, 4), (4, 5)]
    assert wi.coalesced(offsets, lengths, 10_000, 10_000) == [(0, 5)]
    assert wi.coalesced(offsets, lengths, 10_000, 25) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert wi.coalesced(offsets[:0], lengths[:0]) == []
