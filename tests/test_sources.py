import os
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from tradeloom.files import Commits
from tradeloom.session import broadcast_up_to, scratch, shared_dir, stored
from tradeloom.sources import feeds
from tradeloom.sources.numbered import transport
from tradeloom.sources.rest import SourceError, TokenBucket, check_status, http, next_link, pages, probe, records_of, sync


def put(spark, text, name="feed"):
    path = scratch(spark, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text)
    return path


def test_csv(spark):
    path = put(spark, b'ID, Name \n1,"a ""b"", c"\n2\n3,"two\nlines",surplus\n,x\n')
    rows = feeds.identities(feeds.read_csv(spark, path))
    got = {(r.external_product_id, r.error is None) for r in rows.collect()}
    assert got == {("1", True), ("2", True), ("3", True), (None, False)}
    texts = sorted(r.payload for r in rows.collect())
    assert '{"id":"1","name":"a \\"b\\", c"}' in texts and '{"id":"2","name":""}' in texts and '{"id":"3","name":"two\\nlines"}' in texts
    with pytest.raises(feeds.FeedError):
        feeds.read_csv(spark, put(spark, b""))


def test_ndjson_and_policy(spark):
    path = put(spark, b'{"id":7,"a":1}\r\n\n  \n{"id":"x","id":"y"}\nnot json\n{"a":1}\n{"id":"big","t":"' + b"x" * feeds.MAX_LINE + b'"}\n{"id":1.50}')
    rows = feeds.identities(feeds.read_ndjson(spark, path))
    good, bad = feeds.apply_policy(rows, fail_fast=False)
    assert sorted(r.external_product_id for r in good.collect()) == ["1.5", "7", "y"] and bad.count() == 3
    with pytest.raises(Exception, match="row policy"):
        feeds.apply_policy(rows, fail_fast=True)[0].collect()
    part, following = feeds.feed_slice(good, "external_product_id", 0, 2)
    assert part.count() == 2 and following == "offset:2"


def test_metadata(spark):
    df = spark.createDataFrame([('{"v":" ","etag":"e1","updated_at":"no","modified_at":"2026-01-02T03:04:05+02:00"}',), ("{}",)], "payload string")
    a, b = feeds.with_metadata(df).collect()
    assert a.source_version == "e1" and a.source_updated_at is not None and b.source_version is None and b.source_updated_at is None


HEAD = b"hs_code,origin_country,description,effective_from,effective_to,source_reference\n"


@pytest.mark.parametrize("bad", [b"8516,CN,x,2026-13-01,,r\n", b"8516,CN,x,2026-01-01,2026-01-01,r\n", b"851,CN,x,2026-01-01,,r\n", b"8516,CN,x\n"])
def test_curated_is_all_or_nothing(spark, bad):
    good = b'8516, CN ,"x, y",2026-01-01,,r\n85,*,z,2026-01-01,2026-02-01,r\n'
    rows = feeds.read_curated(spark, put(spark, HEAD + good), "IMPORT_RESTRICTION").collect()
    assert sorted(r.origin_country for r in rows) == ["*", "CN"]
    with pytest.raises(feeds.FeedError):
        feeds.read_curated(spark, put(spark, HEAD + good + bad), "IMPORT_RESTRICTION")
    with pytest.raises(feeds.FeedError):
        feeds.read_curated(spark, put(spark, HEAD), "PERMIT")


def test_rest():
    for kind, more in (("page", {}), ("cursor", {"cursor_path": "next"})):
        got = list(pages(transport, "u", {"pagination": kind, "page_size": 50, "records_path": "data.items", **more}))
        assert sum(map(len, got)) == 230
    echo = lambda u, p, h: (200, {}, b'{"items":[{"id":1}],"next":"same"}')
    assert len(list(pages(echo, "u", {"pagination": "cursor", "cursor_path": "next", "records_path": "items"}))) == 2
    assert next_link('<https://x/?page=2&k=v>; rel="next", <https://x/?page=9>; rel="last"') == {"page": "2", "k": "v"} and next_link(None) is None
    for status, kind in ((401, "auth"), (429, "rate_limited"), (503, "unavailable"), (404, "contract")):
        with pytest.raises(SourceError) as e:
            check_status(status)
        assert e.value.kind == kind
    for body in (b"{", b'{"a":1}', b"[1]"):
        with pytest.raises(SourceError):
            records_of(body, "" if body != b'{"a":1}' else "a")
    assert probe(transport, "u", {"records_path": "data.items"})["sample"] is not None
    assert probe(lambda *a: (401, {}, b""), "u", {})["authenticated"] is False
    now = [0.0]
    b = TokenBucket(2, 1, lambda: now[0])
    assert [b.take(), b.take()] == [0.0, 0.5]


def test_records_keep_their_numbers():
    body = b' [ {"b":1.50, "a":1e3} ,{"id":"x"}]'
    assert records_of(body, "") == ['{"b":1.50, "a":1e3}', '{"id":"x"}']
    assert records_of(b'{"d":{"i":[{"b":1.50,"a":[1e3,null,true,"\xc3\xa9"]}]}}', "d.i") == ['{"a":[1e3,null,true,"\u00e9"],"b":1.50}']
    assert records_of(b"[]", ".") == []
    for bad in (b"\xff[]", b"[1]", b"[{}] x"):
        with pytest.raises(SourceError):
            records_of(bad, "")


def test_http_and_checkpoints():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(parse_qsl(urlsplit(self.path).query))
            if self.headers.get("Authorization") != "Bearer k":
                self.send_response(401)
                self.end_headers()
                return
            status, _, body = transport("u", q, {})
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/items"
    options = {"pagination": "page", "page_size": 50, "records_path": "data.items", "auth": "bearer", "secret": "env:TEST_SOURCE_KEY"}
    try:
        with pytest.raises(SourceError):
            list(pages(http, url, options))  # the secret isn't set
        os.environ["TEST_SOURCE_KEY"] = "k"
        kept = []
        assert sync(http, url, options, lambda found, following: kept.append((len(found), following))) == 230
        assert kept == [(50, "page:2"), (50, "page:3"), (50, "page:4"), (50, "page:5"), (30, None)]
        assert sum(map(len, pages(http, url, options | {"checkpoint": "page:4"}))) == 80
        with pytest.raises(SourceError):
            list(pages(http, url, options | {"checkpoint": "cursor:x"}))
        told = probe(http, url, options | {"auth": "none"})
        assert told["reachable"] and not told["authenticated"] and told["seconds"] > 0
    finally:
        server.shutdown()
        os.environ.pop("TEST_SOURCE_KEY", None)
    assert probe(http, url, {})["reachable"] is False


def test_adapters_and_identities(spark):
    path = put(spark, b"SKU,Region\nA, eu\n,us\n")
    read = feeds.adapter("feed")
    assert [r.external_product_id for r in read(spark, feeds.FeedConfig(path, id_field="SKU")).orderBy("external_product_id").collect()] == [None, "A"]
    custom = feeds.FeedConfig(path, custom=lambda c: F.concat(F.get_json_object(c, "$.region"), F.lit("/"), F.get_json_object(c, "$.sku")))
    assert sorted(r.external_product_id for r in read(spark, custom).collect()) == ["eu/A", "us/"]
    with pytest.raises(feeds.FeedError):
        feeds.adapter("SCRAPER")
    good = feeds.with_metadata(read(spark, feeds.FeedConfig(path, id_field="sku")))
    raw = feeds.raw_records(good, " src ", "run", F.lit("2026-01-01").cast("timestamp_ntz")).collect()
    assert len(raw) == 1 and raw[0].source_id == "src" and len(raw[0].id) == 36
    with pytest.raises(ValueError):
        feeds.raw_records(good, " ", "run", F.lit(None).cast("timestamp_ntz"))


def test_core_never_imports_llm():
    code = "import sys, tradeloom.plans.registry, tradeloom.operators.runs, tradeloom.streaming.delivery, tradeloom.sources.rest; sys.exit(any(m.startswith('tradeloom.llm') for m in sys.modules))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}).returncode == 0


def test_shared_dir_is_the_sessions(spark):
    assert scratch(spark, "x").startswith(shared_dir(spark)) and scratch(spark, "x") != scratch(spark, "x")


def test_broadcast_is_by_rows_and_bytes(spark):
    hinted = lambda df: "BroadcastExchange" in spark.range(5).join(df, "id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = stored(spark.range(100).withColumn("t", F.repeat(F.lit("x"), F.lit(1000))).withColumn("a", F.array(F.lit("y"), F.lit(None))), "hundred")
        assert hinted(broadcast_up_to(rows, 100)) and not hinted(broadcast_up_to(rows, 99)) and not hinted(broadcast_up_to(rows, 100, 90_000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_commit_is_made_once(spark, tmp_path):
    a, b = Commits(spark, str(tmp_path)), Commits(spark, f"file://{tmp_path}")
    assert a.last() == (0, {}) and a.make(1, {"x": "é"}) and not b.make(1, {"x": 2}) and b.last() == (1, {"x": "é"})
    assert b.make(2, {}) and a.last()[0] == 2
