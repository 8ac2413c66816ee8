import base64
import hashlib

import pytest

from revlens.llm import warc
from revlens.session import scratch_path

ROWS = [(k, f"http://x.org/{k} \r\n", f"<html>page {k} " + "words in common " * (k % 7)) for k in range(60)]
ROWS += [(100, None, "same"), (101, "http://a", "same"), (99, "http://b", "same"), (102, "http://c", None), (103, "http://d", ""), (None, "http://e", "same"), (None, "http://f", "alone\r\n\r\nline é"), (101, "http://a", "same")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(3)


@pytest.mark.parametrize("trained,archive", [(1 << 20, 1 << 28), (2000, 500)])
def test_round_trip(spark, pages, trained, archive, monkeypatch):
    monkeypatch.setattr(warc, "TRAINED", trained)
    monkeypatch.setattr(warc, "ARCHIVE", archive)
    archives = warc.write(pages, scratch_path(spark, "warc"))
    back = warc.read(archives).collect()
    assert sum(r["records"] for r in archives.collect()) == len(back) == len(ROWS)
    got = sorted((r["page_id"] or -1, r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"] or -1) for r in back)
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        ids = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        to = max(ids) if ids and page != max(ids) else None
        want.append((page or -1, "revisit" if to is not None else "response", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), to or -1))
    assert got == sorted(want)
    stored = sorted(bytes(r["payload"]).decode() for r in back if r["payload"] is not None)
    assert stored == sorted((h or "") for (p, _, h), w in zip(ROWS, want) if w[1] == "response")


def test_short_payloads_do_not_revisit(spark, pages):
    back = warc.read(warc.write(pages, scratch_path(spark, "warc"), least=5)).collect()
    assert {r["record_type"] for r in back} == {"response"}


def test_dictionary_leads_the_archive(spark, tmp_path):
    docs = [f"record {k} with words that repeat and repeat {k * k}".encode() * 20 for k in range(300)]
    archive = warc.Archive(str(tmp_path / "a.zst"), docs)
    for d in docs:
        archive.add(d)
    archive.close()
    data = (tmp_path / "a.zst").read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert list(warc.frames(str(tmp_path / "a.zst"))) == docs
    (tmp_path / "b.zst").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        list(warc.frames(str(tmp_path / "b.zst")))


def test_large_pages_have_a_dictionary_too(spark, tmp_path):
    """Pages of 200 kB, and one of 3 MB alone: fewer records than samples."""
    page = lambda k, n: " ".join(f"<p>word{(i * 7919 + k) % 5003} of {k}</p>" for i in range(n)).encode()
    for name, docs in [("a", [page(k, 10_000) for k in range(5)]), ("b", [page(1, 150_000)])]:
        archive = warc.Archive(str(tmp_path / name), docs)
        for d in docs:
            archive.add(d)
        archive.close()
        assert int.from_bytes((tmp_path / name).read_bytes()[:4], "little") == warc.DICTIONARY_FRAME
        assert list(warc.frames(str(tmp_path / name))) == docs


def test_empty(spark, pages):
    assert warc.archived(pages.limit(0)).collect() == []
