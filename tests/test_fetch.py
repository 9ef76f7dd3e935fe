"""Fetching, with responses played by the test: no server, no port."""

import io
import urllib.error

import pytest

from tallow.sources.fetch import Absent, get_http, open_archive, with_retry

URL = "https://example.org/x.zip"


class Response(io.BytesIO):
    def __init__(self, body=b"", status=200, told=None):
        super().__init__(body)
        self.status = status
        self.headers = {} if told is None else {"Content-Length": str(told)}


class Web:
    """Plays one outcome per request and counts them."""

    def __init__(self, *outcomes):
        self.outcomes = list(outcomes)
        self.requests = 0

    def open(self, url, timeout):
        self.requests += 1
        outcome = self.outcomes.pop(0)
        if isinstance(outcome, Exception):
            raise outcome
        return outcome


def http_error(code):
    return urllib.error.HTTPError(URL, code, "", {}, None)


def fetch(web, retries=3, backoff=2):
    naps = []
    body = with_retry(lambda: get_http(URL, 1, 1, web.open), retries, backoff, naps.append)
    return (body and body.read()), web.requests, naps


def test_success_at_once():
    assert fetch(Web(Response(b"zip"))) == (b"zip", 1, [])


def test_absent_is_not_retried():
    assert fetch(Web(http_error(404))) == (None, 1, [])


def test_server_error_then_success():
    assert fetch(Web(http_error(500), Response(b"zip"))) == (b"zip", 2, [2])


def test_odd_success_code_and_network_error_are_retried():
    web = Web(Response(status=204), ConnectionResetError("gone"), Response(b"zip"))
    assert fetch(web) == (b"zip", 3, [2, 4])


def test_last_failure_is_raised():
    web = Web(*[http_error(503)] * 3)
    with pytest.raises(RuntimeError, match="HTTP 503"):
        fetch(web)
    assert web.requests == 3


def test_body_that_breaks_off_is_fetched_again():
    web = Web(Response(b"zi", told=3), Response(b"zip", told=3))
    assert fetch(web) == (b"zip", 2, [2])


def test_body_that_always_breaks_off_is_an_error():
    web = Web(*[Response(b"zi", told=1000) for _ in range(3)])
    with pytest.raises(ConnectionError, match="2 of 1000 bytes"):
        fetch(web)
    assert web.requests == 3


def test_absent_after_a_failure():
    assert fetch(Web(http_error(500), http_error(404))) == (None, 2, [2])


def test_no_attempt_means_no_data():
    assert fetch(Web(), retries=0) == (None, 0, [])


def test_body_can_be_read_from_its_end():
    body = get_http(URL, 1, 1, Web(Response(b"0123456789")).open)
    body.seek(-3, io.SEEK_END)
    assert body.read() == b"789"


def test_files(tmp_path):
    path = tmp_path / "x.zip"
    path.write_bytes(b"zip")
    for url in (str(path), path.as_uri()):
        assert open_archive(url).read() == b"zip"
    assert open_archive(str(tmp_path / "none.zip")) is None


def test_absent_file_is_told_apart(tmp_path):
    from tallow.sources.fetch import get_file

    with pytest.raises(Absent):
        get_file(str(tmp_path / "none.zip"))
