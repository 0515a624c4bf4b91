import base64
import gzip
import hashlib
import io
import random

import pytest

from obsengine.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def b32(x):
    return base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def rows():
    rng = random.Random(0)
    out = [(i, f"http://x/{i} é\r\n?q", "".join(rng.choices("abc<>é&\n", k=rng.randint(0, 3000))), "clash") for i in range(60)]
    out += [(100 + i, None, out[i % 3][2], "") for i in range(20)] + [(5, out[5][1], out[5][2], ""), (None, "n", out[1][2], ""), (200, "u", None, ""), (201, "u", "", ""), (202, "u", "WARC/1.1\r\n\r\n" * 3, ""), (203, "u", "z" * 3_000_000, "")]
    return out


def want():
    first = {}
    for i, _, h, _ in rows():
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, _ in rows():
        h = h or ""
        again = i is not None and i > first[h]
        out.append((i, len(h.encode()), b32(h), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [1, 7, 1000, 1 << 20])
def test_scan_finds_each_record_once_whatever_the_ranges(split):
    rng = random.Random(1)
    members = [warc.record(i, f"u{i}", bytes(rng.randrange(256) for _ in range(rng.randint(0, 300)))) for i in range(12 if split < 10 else 80)]
    junk = [warc.EMPTY_MEMBER, warc.MAGIC + b"junk", gzip.compress(b"WARC/1.0 but no record"), gzip.compress(b"not a record"), warc.MAGIC]
    raw = b"".join(m + rng.choice([b"", *junk]) for m in members)
    got = [r["page_id"] for at in range(0, len(raw), split) for r in warc.scan(io.BytesIO(raw), at, min(at + split, len(raw)))]
    assert got == list(range(len(members)))


def test_round_trip_through_archives(spark, tmp_path):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    path = str(tmp_path / "a")
    warc.write(warc.with_revisits(pages), path, chunk_bytes=20_000)
    for split in (3000, 8 << 20):
        back = warc.read(spark, path, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == want()
    texts = {(i, u): h for i, u, h, _ in rows()}
    for r in back:
        if r.record_type == "response":
            assert bytes(r.payload).decode() == (texts[r.page_id, r.url] or "")
    # any gzip reader sees the same records one after another
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    assert whole.count(b"WARC-Record-ID") == len(rows())


def test_short_payloads_are_all_responses(spark):
    got = warc.with_revisits(spark.createDataFrame([(1, "", "ab", ""), (2, "", "ab", ""), (3, "", "abcd", ""), (4, "", "abcd", "")], SCHEMA), least_bytes=3).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table(spark, tmp_path):
    warc.write(warc.with_revisits(spark.createDataFrame([], SCHEMA)), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).collect() == []
