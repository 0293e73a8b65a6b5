"""WARC archives with an external-merge capture index.

``write_archives`` writes gzip-member WARC files into the shared folder and
returns one index row per record.  ``merge_index`` orders the index globally by
URL key and timestamp: the sorted capture runs of the archives are dealt by key
range, and each task merges the stretches of runs that come to it with a k-way
loser tree, in rounds of bounded fan-in.  ``read_archives`` follows the merged
index back to the records.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm._store import filesystem, new_folder, publish, staged
from folia.llm._text import batch, mapped

#: Payloads of fewer bytes are always written whole.
MIN_REVISIT_BYTES = 100
#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Index rows that a task holds; more are merged and spilled as a run of their own.
RUN_ROWS = 100_000
#: Runs that are merged at once.
FAN_IN = 256
#: Captures without a time of their own carry this one (seconds since 1970).
NO_TIME = 0

INDEX = pa.schema([("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
INDEX_DDL = "url_key string, ts bigint, page_id bigint, file string, offset bigint, size bigint"


def url_key(url: str | None) -> str:
    """Sort-friendly form: ``http://a.B.org/p?q`` -> ``org,b,a)/p?q``; fragments go."""
    url = (url or "").strip()
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("#")[0].partition("/")
    host, question, query = host.partition("?")
    host = host.rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    labels = ",".join(reversed(name.split(".")))
    return f"{labels}{':' + port if port and port not in ('80', '443') else ''}){slash or '/'}{path}{question}{query}"


def _line(s: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in s)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(kind: str, page_id: int | None, url: str | None, ts: int, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; of a revisit the payload is left out, as its profile says."""
    when = datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {_line(url) if url else 'urn:none'}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {size}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None) -> DataFrame:
    """Writes a record per row and returns the index rows (staged).

    Null html is an empty payload, null urls are written as ``urn:none``.  Of
    equal payloads of at least MIN_REVISIT_BYTES the least page_id is a response
    and the others revisit it; a row that repeats that page_id is a response
    again, and rows without a page_id revisit it.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    ts = F.coalesce(F.col(ts_col).cast("long"), F.lit(NO_TIME)) if ts_col else F.lit(NO_TIME).cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), ts.alias("ts"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # copies of a payload meet in one row per task before the shuffle
    first = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = staged(first.where("n > 1").select("digest", "first_id"), "warc-first")
    rows = rows.join(first, "digest", "left")
    limit = ARCHIVE_BYTES

    def run(batches):
        part = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        made, out, name, index = 0, None, "", []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, index
            if out is None:
                return
            out.close()
            path = publish(folder, name, out.name)
            os.unlink(out.name)
            out = None
            index.sort()  # a run in capture order
            yield batch(INDEX, *zip(*((k, t, i, path, o, n) for k, t, _, i, o, n in index), strict=True))
            index = []

        try:
            for b in batches:
                for digest, page, url, ts, payload, first_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    kind = "response" if first_id is None or page == first_id else "revisit"
                    data = gzip.compress(record(kind, page, url, ts, payload, len(payload), digest, first_id), 6, mtime=0)
                    if out is None:
                        made += 1
                        name = f"captures-{part}-{made:04d}.warc.gz"
                        out = tempfile.NamedTemporaryFile(delete=False)
                    index.append((url_key(url), ts, -1 if page is None else page, page, out.tell(), len(data)))
                    out.write(data)
                    if out.tell() >= limit:
                        yield from close()
            yield from close()
        finally:
            if out is not None:
                out.close()
                os.unlink(out.name)

    return staged(mapped(rows.select("digest", "page_id", "url", "ts", "payload", "first_id"), run, INDEX_DDL), "warc-index")


class LoserTree:
    """Merges k sorted iterators with one comparison per level and row."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.k, self.runs, self.key = max(1, len(runs)), runs, key
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            rival = self.tree[node]
            if rival < 0:  # first to come here waits for the other
                self.tree[node] = winner
                return
            if self._beats(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (w := self.tree[0]) >= 0 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            node = (w + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[3], row[4]


def natural_runs(rows: list[tuple]) -> list[list[tuple]]:
    """Rows cut where their order turns back: what came of a sorted run stays together."""
    out: list[list[tuple]] = []
    last = None
    for row in rows:
        key = _order(row)
        if last is None or key < last:
            out.append([])
        out[-1].append(row)
        last = key
    return out


def _merged(batches, run_rows: int, fan_in: int = FAN_IN) -> Iterator[list[tuple]]:
    """Rows in order, in lists.

    They come as stretches of sorted runs, which are merged as they are.  When
    ``run_rows`` are held they are merged into a run in a local file, and when
    there are ``fan_in`` such files these are merged into one.
    """
    with tempfile.TemporaryDirectory() as folder:
        files, rows, made = [], [], 0

        def tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
            while len(runs) > fan_in:  # neighbours first, each merge of bounded fan-in
                runs = [iter(LoserTree(runs[at : at + fan_in], _order)) for at in range(0, len(runs), fan_in)]
            return iter(LoserTree(runs, _order))

        def lists(merged: Iterator[tuple]) -> Iterator[list[tuple]]:
            while got := list(itertools.islice(merged, 4096)):
                yield got

        def write(merged: Iterator[tuple]) -> str:
            nonlocal made
            path, made = os.path.join(folder, f"run{made}"), made + 1
            with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, INDEX) as w:
                for some in lists(merged):
                    w.write_batch(batch(INDEX, *zip(*some, strict=True)))
            return path

        def read(path: str) -> Iterator[tuple]:
            with pa.OSFile(path) as f, pa.ipc.open_file(f) as r:
                for i in range(r.num_record_batches):
                    yield from zip(*(c.to_pylist() for c in r.get_batch(i).columns), strict=True)

        for b in batches:
            rows.extend(zip(*(c.to_pylist() for c in b.columns), strict=True))
            if len(rows) >= run_rows:
                files.append(write(tree([*map(iter, natural_runs(rows))])))
                rows.clear()
                if len(files) == fan_in:
                    one = write(tree([*map(read, files)]))
                    for path in files:
                        os.unlink(path)
                    files = [one]
        yield from lists(tree([*map(read, files), *map(iter, natural_runs(rows))]))


def merge_index(index: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """The index in global order of url_key, ts, page_id over its partitions.

    Captures of one URL are dealt by time and page too, so a URL with a third of
    all captures fills many ranges.  Captures that are equal in all of these come
    in the order of their archives.
    """
    dealt = index.repartitionByRange("url_key", "ts", "page_id", "offset")

    def run(batches):
        for rows in _merged(batches, run_rows):
            yield batch(INDEX, *zip(*rows, strict=True))

    return staged(dealt.mapInArrow(run, INDEX_DDL), "warc-merged")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("ts", pa.int64()), ("payload", pa.binary())])


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per index row, read back from its archive.

    Of a response the size and digest are those of the bytes read, and a digest
    that differs from the header's is an error; a revisit has its header's.
    Within a batch the records of an archive are read in file order.
    """

    def run(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            got: list = [None] * len(rows)
            opened, fs, file = None, None, None
            for i in sorted(range(len(rows)), key=lambda i: rows[i][3:5]):
                key, ts, page, path, offset, size = rows[i]
                if path != opened:
                    fs = fs or filesystem(path)[0]
                    if file:
                        file.close()
                    file, opened = fs.open_input_file(path), path
                fields, payload = parse_record(gzip.decompress(file.read_at(size, offset)))
                kind, digest, refers = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
                n = int(fields["X-Payload-Bytes"])
                if kind == "response":
                    n, found = len(payload), hashlib.sha256(payload).hexdigest()
                    if found != digest:
                        raise ValueError(f"damaged record in {path} at {offset}")
                else:
                    refers = int(fields["X-Refers-To-Page"]) if fields["X-Refers-To-Page"] != "None" else None
                got[i] = (int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, n, digest, kind, refers, fields["WARC-Target-URI"], key, ts, payload if with_payload else None)
            if file:
                file.close()
            yield batch(RECORDS, *zip(*got, strict=True))

    small = index.select(*INDEX.names)
    return small.mapInArrow(lambda bs: run(c for b in bs for c in (b.slice(at, 1000) for at in range(0, b.num_rows, 1000))), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, url_key string, ts bigint, payload binary")
