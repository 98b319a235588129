"""The listing source against a server that refuses, fails and recovers."""

import http.server
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratavox.sources import listings


@pytest.fixture
def server():
    hits = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hits[self.path] += 1
            hour = self.path.split("/")[2]
            if hour == "06":
                return self.send_error(404)
            if hour == "12" or (hour == "09" and hits[self.path] < 3):
                return self.send_error(503)
            lines = [f'<a href="m_{d}{hour}_{s:03d}_1_clc.grib2.bz2">{s}</a><a href="m_{d}{hour}_{s:03d}_1_clc.grib2.bz2">' for d in ("19950613", "19950614") for s in range(int(hour) // 3 + 1)]
            self.send_response(200)
            self.end_headers()
            self.wfile.write("\n".join([*lines, '<a href="m_19950613_x_clc.grib2">']).encode() + b"\xff")

        def log_message(self, *args):
            pass

    at = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{at.server_port}/grib/{{hour}}/clc/", hits
    at.shutdown()


def test_listings_with_errors_and_retries(spark, server):
    url, hits = server
    df = listings.read(spark, url, "1995061300", "1995061412", retries=2, wait=0.01)
    assert df.rdd.getNumPartitions() == 13
    got = {r.run_str: (r.n, r.e) for r in df.groupBy("run_str").agg(F.count("step").alias("n"), F.max("error").alias("e")).collect()}
    assert len(got) == 13 and got["1995061303"] == (2, None) and got["1995061409"] == (4, None)
    assert got["1995061306"] == (0, "HTTPError: HTTP Error 404: Not Found") and "503" in got["1995061412"][1]
    assert hits["/grib/06/clc/"] == 2 and hits["/grib/12/clc/"] == 6
    assert df.filter("run_str = '1995061303'").count() == 2 and df.filter("run_str = '1995061309'").count() == 4
    kept = {r.run_str: (r.status, r.steps) for r in listings.cache(df, F.lit("1995-06-15").cast("timestamp")).collect()}
    assert kept["1995061303"] == ("success", [0, 1]) and kept["1995061306"] == ("fail", [])


def test_filters_decide_what_is_fetched(spark, server):
    url, hits = server
    one = lambda: listings.read(spark, url, "1995061300", "1995061421", wait=0.01, once=True)
    assert sorted((r.run_str, r.step) for r in one().filter("run_str in ('1995061303', '1995061415') and step >= 1").collect()) == [("1995061303", 1), *(("1995061415", s) for s in range(1, 6))]
    assert set(hits) == {"/grib/03/clc/", "/grib/15/clc/"}
    hits.clear()
    assert one().filter("run_str > '1995061415' and run_str <= '1995061418'").count() == 7 and sum(hits.values()) == 1
    assert one().filter("run_str = '2000010100'").count() == 0 and sum(hits.values()) == 1
    assert one().filter("run_str like '%0613%' and step = 0").count() == 6


def test_nowhere_to_ask(spark):
    row = listings.read(spark, "http://127.0.0.1:9/{hour}", "1995061300", "1995061300", retries=0, timeout=1).first()
    assert row.run_str == "1995061300" and row.step is None and row.error.startswith("URLError")
    with pytest.raises(ValueError):
        listings.runs("1995", "x")
