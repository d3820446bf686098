"""Settings, stores of files, posts, snapshots and archives."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import Row

from quire.operators import library
from quire.sources import settings, sinks, stores


def test_settings():
    text = "# a comment\n\n A = 1\nB='x=y'\nA=2\nnothing\nC=\"\"\n=z"
    assert settings.parsed(text) == {"A": "1", "B": "x=y", "C": "", "": "z"}
    assert settings.merged({"B": "own"}, text)["B"] == "own"
    assert settings.configured({"A": "0", "B": "x"}, "A", "B") and not settings.configured({"A": ""}, "A") and not settings.configured({}, "A")


@pytest.mark.parametrize("key", ["", "/a", "\\a", "a/../b", "..", "c:/x", "a\\..\\b"])
def test_keys_stay_in_their_folder(tmp_path, key):
    for store in (stores.Files(str(tmp_path), "http://x"), stores.Rest("http://x", "k", "b", by=None)):
        for use in (lambda s: s.put(key, b"", "text/plain"), lambda s: s.exists(key), lambda s: s.delete(key)):
            with pytest.raises(ValueError, match="not a key"):
                use(store)


def test_folders(spark, tmp_path):
    store = stores.Files(str(tmp_path), "http://host/")
    files = spark.createDataFrame([("a/b.txt", bytearray(b"1")), ("c.txt", bytearray(b"2"))], "key string, content binary")
    assert {r["key"]: r["url"] for r in stores.stored(files, store, "text/plain").collect()} == {"a/b.txt": "http://host/files/a/b.txt", "c.txt": "http://host/files/c.txt"}
    assert store.exists("a/b.txt") and (tmp_path / "c.txt").read_bytes() == b"2"
    store.delete("a/b.txt")
    store.delete("a/b.txt")
    assert not store.exists("a/b.txt")


@pytest.fixture
def service():
    """A small service that keeps what is sent to it."""
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            seen[self.command, self.path] = body, self.headers.get("X-Ingest-Key")
            self.send_response(404 if "missing" in self.path else 500 if "bad" in self.path else 200)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(b"{}")

        do_POST = do_HEAD = do_DELETE = do  # noqa: N815

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()
    server.server_close()


def test_rest_stores(service):
    url, seen = service
    store = stores.Rest(url, "key", "books")
    assert store.put("a/x", b"data", "text/plain") == f"{url}/storage/v1/object/public/books/a/x"
    assert seen["POST", "/storage/v1/object/books/a/x"][0] == b"data"
    assert store.exists("a/x") and not store.exists("missing")
    store.delete("missing")
    for use in (lambda: store.delete("bad"), lambda: store.put("bad", b"", "text/plain")):
        with pytest.raises(RuntimeError, match="500"):
            use()


def test_posts(spark, service):
    url, seen = service
    rows = spark.createDataFrame([(1, '{"book": 1}')], "id int, payload string")
    assert [tuple(r) for r in stores.posted(rows, url + "/", "/api/ingest", "secret").collect()] == [("1", "{}")]
    assert seen["POST", "/api/ingest"] == (b'{"book": 1}', "secret")
    with pytest.raises(Exception, match="/bad: 500"):
        stores.posted(rows, url, "/bad", "secret").collect()


def test_version_files():
    row = Row(book_id="b1", title="A title/2", kavi=None, payload='{"x": "\u0c95"}')
    name, raw = stores.version_file(row)
    assert name == "b1_A_title_2.json" and json.loads(raw) == {"x": "\u0c95"} and "\u0c95".encode() in raw
    assert stores.version_file(Row(book_id="b1", title="", kavi=None, payload="{}"))[0] == "b1.json"


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "state")
    sinks.swapped(spark.range(3), folder)
    before = sinks.current(spark, folder)
    assert before.count() == 3
    sinks.swapped(before.where("id > 0"), folder)
    assert sorted(r["id"] for r in sinks.current(spark, folder).collect()) == [1, 2]
    assert before.count() == 3


def test_sorted_tables(spark):
    rows = spark.createDataFrame([("1", "b", 2), ("2", "A", 10), ("3", "\u00e4", 9), ("4", "b", 1)], "book_id string, title string, total int")
    order = lambda *a: [r["book_id"] for r in library.sorted_table(rows, *a).collect()]
    assert order("title", False) == ["2", "3", "1", "4"] and order("title") == ["1", "4", "3", "2"] and order("total") == ["2", "3", "1", "4"]
