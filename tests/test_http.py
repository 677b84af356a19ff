"""Ranges from a server of this process that answers as it is told."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pointquarry.sources import copc, http

DATA = bytes(range(256)) * 40


class Told(BaseHTTPRequestHandler):
    """Each request takes the next of ``plan`` (the last for ever): a status, how the body differs, a stated total."""

    plan, asked = [], []

    def do_GET(self):
        step = self.plan[min(len(self.asked), len(self.plan) - 1)]
        self.asked.append(self.headers["Range"])
        begin, end = (int(v) for v in self.headers["Range"].removeprefix("bytes=").split("-"))
        if step.get("hang"):
            time.sleep(step["hang"])
        body = DATA[begin : end + 1]
        body = body[: step["cut"]] if "cut" in step else body + b"x" * step.get("more", 0)
        self.send_response(step.get("status", 206))
        if not step.get("untold"):
            self.send_header("Content-Range", f"bytes {begin}-{begin + len(body) - 1}/{step.get('total', len(DATA))}")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    found = ThreadingHTTPServer(("127.0.0.1", 0), Told)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}/a.copc.laz"
    found.shutdown()


def reader(server, plan, **settings):
    Told.plan, Told.asked = plan, []
    return http.Ranges(server, seed=1, sleep=lambda s: None, **settings)


@pytest.mark.parametrize(
    "plan,attempts",
    [([{}], 1), ([{"status": 503}, {"status": 429}, {}], 3), ([{"cut": 7}, {"cut": 0}, {"cut": 3, "untold": True}, {}], 4)],
)
def test_what_mends_itself(server, plan, attempts):
    assert reader(server, plan).read(100, 140) == DATA[100:140]
    assert Told.asked == ["bytes=100-139"] * attempts


@pytest.mark.parametrize(
    "plan,error,attempts",
    [
        ([{"status": 404}], http.RangeError, 1),
        ([{"status": 416}], http.RangeError, 1),
        ([{"status": 200}], http.RangeError, 1),
        ([{"more": 5}], http.RangeError, 1),
        ([{"status": 500}], OSError, 4),
        ([{"cut": 2}], OSError, 4),
    ],
)
def test_what_does_not(server, plan, error, attempts):
    with pytest.raises(error):
        reader(server, plan).read(0, 30)
    assert len(Told.asked) == attempts


def test_the_end_of_the_file_and_a_false_one(server):
    r = reader(server, [{}])
    assert r.read(len(DATA) - 5, len(DATA) + 50) == DATA[-5:]
    assert r.total == len(DATA)
    Told.plan, Told.asked = [{"cut": 10, "total": 10}], []
    with pytest.raises(OSError):
        r.read(0, 30)
    assert len(Told.asked) == 4


def test_a_silent_server(server):
    with pytest.raises(OSError):
        reader(server, [{"hang": 2.6}], limit_s=0.05, attempts=2).read(0, 4)
    assert len(Told.asked) == 2


def test_waits_grow_with_jitter():
    a, b = (http.Ranges("u", seed=s) for s in (1, 2))
    first, second = [a.waits(k) for k in range(6)], [b.waits(k) for k in range(6)]
    assert first != second
    assert all(min(3.0, 0.3 * 2**k) <= w <= 3.0 for k, w in enumerate(first))
    assert first == [w for r in (http.Ranges("u", seed=1),) for w in (r.waits(k) for k in range(6))]


def test_hierarchies_are_read_by_url(server):
    Told.plan, Told.asked = [{"status": 503}, {}], []
    http.READERS.clear()
    http.READERS[server] = http.Ranges(server, sleep=lambda s: None)
    assert copc.read_range(server, 3, 9) == DATA[3:9]
    with pytest.raises(ValueError, match="of 10 bytes"):
        copc.read_range(server, len(DATA) - 4, len(DATA) + 6)
