"""Bundles: the seek table, single-record access, revisits and the round trip."""

from __future__ import annotations

import hashlib
import io

import zstandard

from reelflow.llm import warc
from reelflow.llm.shared import filesystem

PAGES = "page_id bigint, url string, html string"
BODY = "<p>" + "x" * 200 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_round_trip_with_revisits(spark):
    rows = [(k, f"http://h/{k}", f"<html>page {k} é</html>" * (k % 7)) for k in range(60)]
    rows += [(100 + k, "http://copy/", BODY) for k in range(20)] + [(300, "u", "short"), (301, "u", "short"), (400, None, None)]
    folder, index = warc.write_bundles(pages(spark, rows), frame_bytes=2000, bundle_bytes=6000)
    got = {r.page_id: r for r in warc.read_bundles(folder, index).collect()}
    assert len(got) == len(rows)
    first: dict = {}
    for page_id, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        first.setdefault(data, page_id)
        later = len(data) >= 100 and first[data] != page_id
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[data]) if later else ("response", None))


def test_bundle_is_seekable_and_plain_zstandard(spark):
    rows = [(k, f"http://h/{k}", f"<html>{'y' * 500} {k}</html>") for k in range(40)]
    folder, index = warc.write_bundles(pages(spark, rows).coalesce(1), frame_bytes=3000)
    entries = index.collect()
    assert len({e.bundle for e in entries}) == 1 and len({e.frame for e in entries}) > 5
    for e in entries[::7]:
        fields, block = warc.fetch(folder, e.bundle, e.frame, e["at"], e.length)
        assert fields["X-Page-ID"] == str(e.page_id) and fields["WARC-Record-ID"] == f"<urn:uuid:{e.record_id}>"
        assert block.decode() == rows[e.page_id][2]
    fs, root = filesystem(folder)
    data = fs.open_input_file(f"{root}/{entries[0].bundle}").read()
    whole = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True): r.read(1 << 16), b""))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    magic = int.from_bytes(data[-4:], "little")
    assert magic == 0x8F92EAB1 and int.from_bytes(data[-9:-5], "little") == len({e.frame for e in entries})


def test_odd_rows(spark):
    rows = [(None, "u", BODY), (None, "u", BODY), (5, "u", BODY), (5, "u", BODY), (6, "a b\r\nX: y", BODY), (7, "u", ""), (8, "u", "z" * 3_000_000)]
    clash = spark.createDataFrame([(*r, 1, 2, "d") for r in rows], PAGES + ", payload int, first int, digest string").repartition(2)
    folder, index = warc.write_bundles(clash)
    got = warc.read_bundles(folder, index).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    assert sorted(r.record_type for r in got if r.page_id == 5) == ["response"] * 2
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 6] == [("revisit", 5)]
    assert {(r.record_type, r.refers_to) for r in got if r.page_id is None} == {("revisit", 5)}
    folder, index = warc.write_bundles(spark.createDataFrame([], PAGES))
    assert warc.read_bundles(folder, index).count() == 0
    alone = warc.write_bundles(spark.createDataFrame([(None, "u", BODY)] * 2, PAGES))
    assert {r.record_type for r in warc.read_bundles(*alone).collect()} == {"response"}
