"""Landing on executors: ranges, verified pages, failures that leave nothing, nothing fetched twice."""
import http.server
import json
import random
import re
import threading
from collections import Counter
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewheel.sources import files, landing

BODY = random.Random(4).randbytes(100_000)


class Server:
    """Serves /whole (no ranges), /ranged, /short (ranges come short), and pages of 25 rows; counts what is asked for."""

    def __init__(self):
        self.asked, self.rows, self.count, outer = Counter(), 25, 25, self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_HEAD(self):
                self.send_response(200)
                if self.path != "/untold":
                    self.send_header("Content-Length", str(len(BODY)))
                self.end_headers()

            def do_GET(self):
                path, q = urlparse(self.path).path, parse_qs(urlparse(self.path).query)
                span = re.match(r"bytes=(\d+)-(\d+)", self.headers.get("Range") or "")
                outer.asked[f"{path} {span[0] if span else q or ''}"] += 1
                status, body = 200, BODY
                if path == "/page":
                    o, n = int(q["o"][0]), int(q["n"][0])
                    body = json.dumps([{"name": f"r{i}", "geo": [i]} for i in range(o, min(o + n, outer.rows))]).encode()
                elif path == "/count":
                    body = json.dumps([{"count": str(outer.count)}]).encode()
                elif span and path in ("/ranged", "/short"):
                    status, body = 206, BODY[int(span[1]) : int(span[2]) + 1][: 10 if path == "/short" else None]
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def everything(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")) if folder.exists() else []


def test_ranges_are_tasks_and_files_are_fetched_once(spark, server, tmp_path):
    to = tmp_path / "landed"
    urls = [(f"{server.url}/ranged", "a.zip"), (f"{server.url}/whole", "sub/b.zip"), (f"{server.url}/untold", "c.zip")]
    got = {r.name: (r.bytes, r.fetched) for r in landing.land(spark, urls, str(to), block=30_000).collect()}
    assert got == {n: (len(BODY), True) for _, n in urls}
    assert all((to / n).read_bytes() == BODY for _, n in urls) and everything(to) == ["a.zip", "c.zip", "sub/b.zip"]
    assert {k for k in server.asked if k.startswith("/ranged")} == {f"/ranged bytes={s}-{min(s + 30_000, 100_000) - 1}" for s in range(0, 100_000, 30_000)}
    before = sum(server.asked.values())
    assert {r.fetched for r in landing.land(spark, urls, str(to), block=30_000).collect()} == {False}
    assert sum(server.asked.values()) == before


def test_a_failed_range_leaves_nothing(spark, server, tmp_path):
    to = tmp_path / "landed"
    with pytest.raises(Exception, match="10 bytes of"):
        landing.land(spark, [(f"{server.url}/ranged", "good"), (f"{server.url}/short", "bad")], str(to), block=30_000)
    assert everything(to) == []
    assert landing.land(spark, [(f"{server.url}/ranged", "good")], str(to)).first().fetched  # and the next run starts clean


def test_files_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.txt", f"text {i}") for i in range(20)] + [("none.txt", None)], "name string, content string").repartition(4)
    to = tmp_path / "out"
    bad = rows.withColumn("content", F.when(F.col("name") == "7.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        landing.write_files(bad, str(to))
    assert everything(to) == []
    landing.write_files(rows, str(to))
    assert everything(to) == sorted([f"{i}.txt" for i in range(20)] + ["none.txt"]) and (to / "7.txt").read_text() == "text 7" and (to / "none.txt").read_bytes() == b""


def test_local_files_land_too(spark, tmp_path):
    (tmp_path / "there").write_bytes(BODY)
    landing.land(spark, [(f"file://{tmp_path}/there", "copy")], str(tmp_path / "to"), block=1 << 15)
    assert (tmp_path / "to/copy").read_bytes() == BODY
    with pytest.raises(Exception, match="FileNotFound"):
        landing.land(spark, [(f"file://{tmp_path}/missing", "x")], str(tmp_path / "to"))


def test_pages_are_fetched_once_and_verified(spark, server, tmp_path):
    ask = lambda name: landing.land_paged(spark, server.url + "/page?o={offset}&n={limit}", f"{server.url}/count", ["name", "geo"], str(tmp_path / name), page=10)
    rows = ask("table").collect()
    assert sorted(r.name for r in rows) == sorted(f"r{i}" for i in range(25)) and rows[0].geo.startswith("[")
    assert sorted(server.asked.values()) == [1, 1, 1, 1]  # the count and three pages
    ask("table").count()
    assert sum(server.asked.values()) == 4
    server.count = 26
    with pytest.raises(ValueError, match="expected 26 rows, got 25"):
        ask("short")
    server.count, server.rows = 20, 25  # rows that came after the count was asked for are on no page of it
    assert ask("grown").count() == 20
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name or p.name == "short"]
    server.count = server.rows = 0
    assert ask("empty").collect() == []
