import gzip
import hashlib
import base64

from tephra.llm import common, warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2\r\nEvil: x", "<p>one</p>"), (3, None, None), (4, "http://b/", ""), (5, "http://a/5", "<p>five é" + "y" * 30000),
    (6, "http://b/6", "<p>one</p>"), (6, "http://b/6", "<p>one</p>"), (None, "http://c", "alone"), (None, "http://c", "<p>one</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, key string, first string")


def test_round_trip(spark):
    folder = warc.write_pages(pages(spark))
    got = {(r.record_id, r.record_type, r.refers_to, r.payload_digest, r.http_length, r.payload) for r in warc.read_warc(spark, folder).collect()}
    want = set()
    for page, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        to = max(same) if same and page != max(same) else None
        digest = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.add((f"urn:page:{'null' if page is None else page}", "revisit" if to else "response", f"urn:page:{to}" if to else None, digest, len(data), None if to else data))
    assert got == want
    assert warc.read_warc(spark, folder).count() == len(PAGES)


def test_small_payloads_are_responses(spark):
    folder = warc.write_pages(pages(spark), min_bytes=5)
    kinds = {r.record_id: r.record_type for r in warc.read_warc(spark, folder).collect()}
    assert kinds["urn:page:3"] == kinds["urn:page:4"] == "response" and kinds["urn:page:1"] == "revisit"


def test_filters_are_pushed_and_payloads_skipped(spark):
    folder = warc.write_pages(pages(spark))
    some = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit' and target_uri like 'http://a%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:1", "urn:page:2"]
    assert all(r.payload is None for r in some.collect())


def test_members_of_other_writers_and_plain_files(spark, tmp_path):
    made = [warc.record("response", f"urn:page:{k}", f"http://x/{k}", warc.payload_digest(b"z" * k), b"z" * k) for k in (0, 7, 70_000)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    (tmp_path / "b.warc").write_bytes(b"".join(made))
    for payload in (True, False):
        got = [(r.record_id, r.http_length, r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}", payload).collect()]
        assert sorted(got) == sorted((f"urn:page:{k}", k, b"z" * k if payload else None) for k in (0, 7, 70_000) for _ in (1, 2))


def test_empty_table(spark):
    assert warc.read_warc(spark, warc.write_pages(pages(spark, []))).count() == 0


def test_members_hold_their_lengths():
    data = warc.member(b"x" * 1000)
    assert gzip.decompress(data) == b"x" * 1000 and int.from_bytes(data[16:20], "little") == len(data)


def test_empty_table_and_digests_of_what_is_in_the_files(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_pages(none)).collect() == []
    df = spark.createDataFrame([(1, "u", "one"), (2, "u", "one"), (3, None, None), (None, "u", "two")], "page_id long, url string, html string")
    folder = warc.write_pages(df)
    got = {r.record_id: r for r in warc.read_warc(spark, folder, payload=False, digest=True).where("record_type = 'response'").collect()}
    assert {k: (r.payload, r.payload_length, r.payload_sha1) for k, r in got.items()} == {f"urn:page:{k}": (None, len(b), warc.payload_digest(b)) for k, b in ((2, b"one"), (3, b""), ("null", b"two"))}
    assert {r.payload_sha1 for r in warc.read_warc(spark, folder).collect()} == {None}
