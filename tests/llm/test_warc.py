import base64
import gzip
import hashlib
import random

import pytest

from cohortscope.llm import warc as A
from tests.llm.helpers import clashing


def test_round_trip_through_files(spark, tmp_path):
    pages = [(1, "http://a/b c", "<p>é</p>\r\n\r\nx"), (2, None, None), (3, "u", ""),
             (4, "u", "<p>é</p>\r\n\r\nx"), (5, "u", "z" * 300_000), (6, "u\r\nX: y", "same"),
             (6, "v", "same"), (7, "w", "same"), (None, "n", "same")]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    A.write_archives(df, str(tmp_path / "w"), per_file=2)
    got = A.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(pages)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = sorted((str(i), len((h or "").encode()), digest(h or "")) for i, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("1", "response", None), ("2", "response", None), ("3", "revisit", 2),
                     ("4", "revisit", 1), ("5", "response", None), ("6", "response", None),
                     ("6", "response", None), ("7", "revisit", 6), ("None", "response", None)]
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.page_id in (1, 5)} == {
        1: pages[0][2], 5: pages[4][2]}
    files = list((tmp_path / "w").rglob("part-*"))
    assert len(files) >= 4
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(pages)


def test_files_are_bounded_by_bytes_and_writing_keeps_all_bytes(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    pages = [(i, "u", "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(128, 0x800)]))
                              for _ in range(rnd.choice([10, 3000, 90_000])))) for i in range(120)]
    pages.append((500, "u", rnd.randbytes(40_000).decode("latin-1")))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    monkeypatch.setattr(A, "BATCH_BYTES", 100_000)
    A.write_archives(df, str(tmp_path / "b"), file_bytes=150_000)
    files = list((tmp_path / "b").rglob("part-*"))
    assert len(files) > 10 and max(f.stat().st_size for f in files) < 150_000 + 250_000
    got = {r.page_id: bytes(r.payload).decode() for r in A.read_archives(
        spark, str(tmp_path / "b")).filter("record_type = 'response'").collect()}
    # bytes that are no UTF-8 pass through the text writer: a changed one would break the digests
    assert got == {i: t for i, _, t in pages}


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                               "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in A.with_references(df, min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_damage_is_found(spark, tmp_path):
    good = A.build_record(1, "u", b"payload")
    assert [r[0] for r in A.read_archive(good + A.BETWEEN + good)] == [1, 1]
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload", b"paylord"), plain[:-1], b"nothing\r\n\r\n"):
        with pytest.raises(ValueError):
            list(A.read_archive(gzip.compress(bad)))
    with pytest.raises(ValueError):
        list(A.read_archive(good[:-4]))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    A.write_archives(empty, str(tmp_path / "e"))
    assert A.read_archives(spark, str(tmp_path / "e")).count() == 0
