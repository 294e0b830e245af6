"""Discovery against a server: the rate it sees, one scan for items and errors, days and pages asked for once."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quarryflow import cli
from quarryflow.sources import http, providers


class Server:
    """Pages of two items a venue; notes when each request came."""

    def __init__(self):
        self.requests, self.answers = [], []  # (time, query); statuses and headers of the next answers
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.requests.append((time.monotonic(), query))
                status, headers = outer.answers.pop(0) if outer.answers else (200, {})
                asked = dict(x.split(":", 1) for x in query.get("filter", "").split(",") if ":" in x)
                issn, n = asked.get("issn", "?"), 2 if query.get("cursor") == "*" else 0
                status = 404 if issn == "bad" else status
                items = [{"title": [f"{issn} {i} {asked.get('from-pub-date')}"], "DOI": f"10.1/{issn}.{i}"} for i in range(n)]
                body = json.dumps({"message": {"items": items, "next-cursor": "next"}}).encode()
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/works"

    def gaps(self):
        times = [t for t, _ in self.requests]
        return [b - a for a, b in zip(times, times[1:], strict=False)]


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def keys(n):
    return [{"issn": f"{i:04d}"} for i in range(n)]


SPAN = {"from_date": "2026-01-01", "to_date": "2026-01-03", "max_per_key": 2, "tries": 1}


def test_a_lane_holds_its_rate_and_one_scan_gives_all(spark, server):
    began = time.monotonic()
    items, errors = providers.discover(spark, "crossref", [*keys(24), {"issn": "bad"}], base_url=server.url, pause=0.2, **SPAN)
    assert time.monotonic() - began >= 24 * 0.2
    assert min(server.gaps()) >= 0.19
    assert items.count() == 48 and [json.loads(r.key)["issn"] for r in errors.collect()] == ["bad"]
    assert items.count() == 48 and len(server.requests) == 25  # whatever is read of it, each key was asked once
    assert sorted(r.row_ord for r in items.collect()) == sorted((k << 32) + i for k in range(24) for i in range(2))


def test_lanes_share_the_keys(spark, server):
    items, _ = providers.discover(spark, "crossref", keys(12), base_url=server.url, pause=0.3, lanes=3, **SPAN)
    assert items.count() == 24 and len(server.requests) == 12
    last = server.requests[-1][0] - server.requests[0][0]
    assert 3 * 0.3 <= last
    for at, (t, _) in enumerate(server.requests):  # three lanes: four requests are 0.3 seconds apart
        assert at + 3 >= len(server.requests) or server.requests[at + 3][0] - t >= 0.25


def test_all_of_a_lane_wait_when_a_server_asks_to(spark, server):
    server.answers.append((429, {"Retry-After": "1"}))
    items, errors = providers.discover(spark, "crossref", keys(3), base_url=server.url, **{**SPAN, "tries": 2})
    assert items.count() == 6 and errors.count() == 0
    assert server.gaps()[0] >= 1 and len(server.requests) == 4


def test_pacing_counts_from_the_end_of_a_request():
    now, slept = [0.0], []

    def wait(s):
        slept.append(round(s, 3))
        now[0] += s

    def fetch(url):
        now[0] += 0.5
        if url == "bad":
            raise OSError
        return {}

    paced = http.Paced(fetch, 0.2, lambda: now[0], wait)
    paced("a")
    with pytest.raises(OSError):
        paced("bad")
    now[0] += 0.05
    paced("b")
    assert slept == [0.2, 0.15]


def days(server):
    return sorted({(q["filter"].split("from-pub-date:")[1].split(",")[0], q["filter"].split("until-pub-date:")[1].split(",")[0]) for _, q in server.requests})


def test_a_stream_asks_for_each_day_once(spark, server, tmp_path):
    def scan(to_date):
        stream = providers.discover_stream(spark, "crossref", keys(3), base_url=server.url, **{**SPAN, "to_date": to_date})
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert scan("2026-01-03") == 6
    assert days(server) == [("2026-01-01", "2026-01-03")]
    server.requests.clear()
    assert scan("2026-01-03") == 6 and server.requests == []
    assert scan("2026-01-05") == 12
    assert days(server) == [("2026-01-04", "2026-01-05")]


def test_a_scan_that_died_asks_no_page_twice(spark, server, tmp_path):
    def scan(sink):
        stream = providers.discover_stream(spark, "crossref", keys(5), base_url=server.url, pages=str(tmp_path / "pages"), **SPAN)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination(60)

    def dies(batch, number):
        batch.count()
        raise RuntimeError("gone")

    with pytest.raises(Exception, match="gone"):
        scan(dies)
    assert len(server.requests) == 5
    found = []
    scan(lambda batch, number: found.extend(batch.collect()))
    assert len(found) == 10 and len(server.requests) == 5
    items, _ = providers.discover(spark, "crossref", keys(6), base_url=server.url, pages=str(tmp_path / "pages"), **SPAN)
    assert items.count() == 12 and len(server.requests) == 6


def test_scan_command_goes_on_after_it_died(spark, server, tmp_path, capsys):
    (tmp_path / "profile-kg.md").write_text("# P\n\n## Core keywords\n\n- graph\n")
    (tmp_path / "venues.json").write_text(json.dumps([{"journal": "J", "issn": "1111", "pool": "p", "kind": "journal"}, {"journal": "K", "issn": "bad", "pool": "p", "kind": "journal"}]))
    base = ["scan", "--profile", str(tmp_path / "profile-kg.md"), "--venues", str(tmp_path / "venues.json"), "--from-date", "2026-01-01", "--to-date", "2026-01-02", "--crossref-url", server.url, "--pause", "0", "--tries", "1", "--max-per-venue", "2", "--pages", str(tmp_path / "pages")]
    for i in range(2):
        assert cli.main([*base, "--out", str(tmp_path / f"out{i}")]) == 1
        out = json.loads(capsys.readouterr().out)
        assert (out["found"], len(out["errors"])) == (2, 1)
    assert [q["filter"].split(",")[0] for _, q in server.requests].count("issn:1111") == 1
