import base64
import hashlib

from tallyloom.llm import warc

INNER = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"
ROWS = [
    (5, "http://a/1", "<p>é one</p>"), (3, "http://a/2", "<p>é one</p>"), (9, None, ""), (8, "http://a/\r\nX: y", None), (7, "http://b", INNER + " tail " + INNER),
    (6, "http://b/2", INNER + " tail " + INNER), (4, "u", "a\r\n\r\nb\r\n\r\n"), (2, "u", "\r\n"), (1, "u", "x" * 70000 + "WARC/1.0\r\n"), (3, "http://a/2", "<p>é one</p>"), (3, "dup", "other"), (None, "n", "other"),
]


def expected(rows):
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        least = min((q for q, _, x in rows if (x or "") == (h or "") and q is not None), default=None)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if p == least else ("revisit", least))))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    warc.write(pages, f"file://{tmp_path}/w", records_a_file=3)
    got = warc.read(spark, f"file://{tmp_path}/w", payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(ROWS)
    texts = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert texts[6] == INNER + " tail " + INNER and texts[8] == "" and texts[4] == "a\r\n\r\nb\r\n\r\n" and texts[1].endswith("xWARC/1.0\r\n")


def test_urls_forge_no_field(spark, tmp_path):
    odd = [f"http://a/{c}Content-Length: 3{c}WARC-Refers-To: <urn:page:9>{c}WARC-Payload-Digest: sha1:X{c}WARC-Type: revisit" for c in ("\u2028", "\x85", "\u2029", "\r", "\n", "\r\n", "\x0b", "\x0c")]
    rows = [(i, u, f"<p>{i // 2}</p>") for i, u in enumerate(odd)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    # a foreign file may hold them as they are
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.warc").write_bytes("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\u2028Content-Length: 3\x85WARC-Type: revisit\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n".encode())
    assert [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.read(spark, f"file://{tmp_path}/f").collect()] == [(4, "response", 3)]


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0


def test_small_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = [(i, f"http://h/{i}", ("WARC/1.0\r\n" if i % 7 == 0 else "") + f"page {i} " + "w" * (i * 37 % 900)) for i in range(60)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
        warc.write(pages, f"file://{tmp_path}/w")
        got = warc.read(spark, f"file://{tmp_path}/w").collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
