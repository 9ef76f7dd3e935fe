"""Getting one archive: HTTP or file system, with retries."""

import http.client
import shutil
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import BinaryIO

# An archive larger than this is spilled to disk by the task that holds it: to its own
# temporary folder, as a file no one else sees, which goes when it is closed.
SPOOL_BYTES = 64 << 20


class Absent(Exception):
    """There is no such archive."""


def with_retry(
    attempt_once: Callable[[], BinaryIO],
    retries: int = 3,
    backoff: int = 2,
    sleep: Callable[[float], None] = time.sleep,
) -> BinaryIO | None:
    """The first success. None if the archive is absent, or if no attempt is allowed."""
    for attempt in range(1, retries + 1):
        if attempt > 1:
            sleep(backoff ** (attempt - 1))
        try:
            return attempt_once()
        except Absent:
            return None
        except Exception as error:
            failure = error
    if retries > 0:
        raise failure
    return None


def _patient(connection: type, read_timeout: float) -> type:
    """A connection class that, once connected, waits ``read_timeout`` for data."""

    class Patient(connection):
        def connect(self):
            super().connect()
            self.sock.settimeout(read_timeout)

    return Patient


def _opener(read_timeout: float) -> urllib.request.OpenerDirector:
    class Http(urllib.request.HTTPHandler):
        def http_open(self, request):
            return self.do_open(_patient(http.client.HTTPConnection, read_timeout), request)

    class Https(urllib.request.HTTPSHandler):
        def https_open(self, request):
            return self.do_open(_patient(http.client.HTTPSConnection, read_timeout), request)

    return urllib.request.build_opener(Http, Https)


def get_http(url: str, connect_timeout: float, read_timeout: float, open_url=None) -> BinaryIO:
    """The body of a 200 response, as a seekable file: a zip is read from its end."""
    open_url = open_url or _opener(read_timeout).open
    try:
        with open_url(url, timeout=connect_timeout) as response:
            if response.status != 200:
                raise RuntimeError(f"HTTP {response.status}")
            body = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
            shutil.copyfileobj(response, body, 1 << 20)
            # reading by size does not raise when the body breaks off
            told = response.headers.get("Content-Length")
            if told is not None and body.tell() != int(told):
                raise ConnectionError(f"{body.tell()} of {told} bytes came")
    except urllib.error.HTTPError as error:
        if error.code == 404:
            raise Absent(url) from None
        raise RuntimeError(f"HTTP {error.code}") from None
    body.seek(0)
    return body


def file_system(url: str):
    """Arrow's file system for a path, and the path on it; no scheme means a mounted one."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:"):
        # Hadoop's name for the scheme is not Arrow's
        return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), url


def get_file(url: str) -> BinaryIO:
    system, path = file_system(url)
    try:
        # a mounted file is opened as such: zip reading expects its kind of seek errors
        return open(path, "rb") if system.type_name == "local" else system.open_input_file(path)
    except FileNotFoundError:
        raise Absent(url) from None


def open_archive(
    url: str,
    retries: int = 3,
    backoff: int = 2,
    connect_timeout: float = 10,
    read_timeout: float = 60,
) -> BinaryIO | None:
    def attempt() -> BinaryIO:
        if url.startswith(("http://", "https://")):
            return get_http(url, connect_timeout, read_timeout)
        return get_file(url)

    return with_retry(attempt, retries, backoff)
