"""WARC archives of captured pages and their merged capture index."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Workspace, shuffle_partitions

RUN_ROWS = 50_000  #: captures of one locally sorted run
SAMPLES_A_RUN = 32  #: regular samples of each run, from which the merge's ranges are cut
FILE_BYTES = 64 << 20  #: a WARC file is closed beyond this size
SLICE_ROWS = 100_000  #: captures of one merge, about
MOST_SAMPLES = 1 << 17  #: samples that reach the driver, about
READ_BYTES = 4 << 20  #: of an archive's records that are read together
TASK_BYTES = 16 << 20  #: of records that one task reads, about
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)

RUN_SCHEMA = (
    "run string, nth int, url_key string, capture_ts long, page_id long, url string, record_type string, "
    "refers_to long, path string, offset long, length long, sample boolean"
)
RECORD_SCHEMA = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, path string, offset long, url_key string, capture_ts long, capture_rank long"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query in lower case; scheme and fragment dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return (key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so a step replays one leaf-to-root path."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.loser = [0] * max(self.k, 1)
        self.winner = self._build(1) if self.k else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(b, a):
            a, b = b, a
        self.loser[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (top := self.head[self.winner]) is not None:
            yield top
            w = self.winner
            self.head[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node >= 1:
                if self._beats(self.loser[node], w):
                    w, self.loser[node] = self.loser[node], w
                node //= 2
            self.winner = w


def _record(page_id, url: str, ts: int, kind: str, refers_to, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds no payload."""
    when = (EPOCH + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{page_id}')}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Capture-Number: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{refers_to}')}>",
            f"X-Refers-To-Capture-Number: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=4, mtime=0)


def _writer(folder: str, run_rows: int):
    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        entries, out, path, at = [], None, "", 0

        def run() -> pa.RecordBatch:
            entries.sort(key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2]))
            name = uuid.uuid4().hex
            step = max(1, len(entries) // SAMPLES_A_RUN)
            cols = list(zip(*((name, i, *e, i % step == step - 1) for i, e in enumerate(entries)), strict=True))
            entries.clear()
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    # A task that runs again writes under another name; only files named in the kept rows are ever read.
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)  # members are compressed one by one; the name alone would compress them again
                payload, url, page = r["payload"] or b"", (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"), r["page_id"]
                first = r["first_id"]
                kind = "revisit" if first is not None and page is not None and first != page else "response"
                ts = 0 if page is None else page % (10**9)
                blob = _record(page, url, ts, kind, first, payload, payload_digest(payload))
                out.write(blob)
                entries.append((url_key(url), ts, page, url, kind, first if kind == "revisit" else None, path, at, len(blob)))
                at += len(blob)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
                if len(entries) >= run_rows:
                    yield run()
        if out is not None:
            out.close()
        if entries:
            yield run()

    return write


def _parse(blob: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record, a gzip member of its own."""
    try:
        record = zlib.decompress(blob, wbits=31)
    except zlib.error as e:
        raise ValueError("no whole record") from e
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _reader(folder: str):
    """Read records at the index's places; a task's rows come by path and offset, so that each archive is opened once and read forwards."""

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        path, raw = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    if raw is not None:
                        raw.close()
                    path, raw = r["path"], fs.open_input_file(r["path"])
                headers, payload = _parse(raw.read_at(r["length"], r["offset"]))
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"payload of {path} at {r['offset']} differs from its digest")
                page, refers = headers["X-Capture-Number"], headers.get("X-Refers-To-Capture-Number")
                page, refers = int(page) if page else None, int(refers) if refers else None
                if (page, kind) != (r["page_id"], r["record_type"]):
                    raise ValueError(f"the index names another record than stands in {path} at {r['offset']}")
                rows.append((page, kind, refers, len(payload) if kind == "response" else None, digest, headers["WARC-Target-URI"], path, r["offset"], r["url_key"], r["capture_ts"], r["capture_rank"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if raw is not None:
            raw.close()

    return read


def write_archives(ws: Workspace, pages: DataFrame, id_col: str, url_col: str, html_col: str, min_payload: int) -> DataFrame:
    """Write one record a page; return the locally sorted capture runs."""
    html = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    caps = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    caps = caps.withColumn("sha1", F.sha1("payload"))
    seen = caps.filter(F.octet_length("payload") >= min_payload).select("page_id", "sha1")
    copies = ws.save(
        seen.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "copies",
    )
    marked = caps.join(copies, "sha1", "left").select("page_id", "url", "payload", "first_id")
    folder = f"{ws.base}/archives"
    _make_folder(ws, folder)
    return ws.save(marked.mapInArrow(_writer(folder, RUN_ROWS), RUN_SCHEMA), "runs")


def _make_folder(ws: Workspace, folder: str) -> None:
    path = ws.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(ws.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def merge_index(ws: Workspace, runs: DataFrame) -> DataFrame:
    """Merge sorted runs into one index ordered by (url_key, capture_ts, page_id).

    Regular samples of the runs (about MOST_SAMPLES at most: of more, those with the smallest hashes) are cut into ranges of the composite key of about SLICE_ROWS captures, so that
    the captures of one URL may spread over ranges. A task merges its slice of every run with a loser tree over the runs' keys; the columns are taken in the merged order. A
    range's rank offset is the sum of the ranges before it.
    """
    total, sampled = runs.agg(F.count("*"), F.count_if("sample")).first()
    n = max(shuffle_partitions(ws.spark), -(-total // SLICE_ROWS))
    thin = max(1, -(-sampled // MOST_SAMPLES))
    few = runs.filter("sample").filter(F.pmod(F.xxhash64("run", "nth"), F.lit(thin)) == 0).select("url_key", "capture_ts", "page_id").toArrow()
    picks = sorted(zip(*(few.column(c).to_pylist() for c in ("url_key", "capture_ts")), (-1 if p is None else p for p in few.column("page_id").to_pylist()), strict=True))
    cuts = sorted({picks[len(picks) * i // n] for i in range(1, n)}) if picks else []
    shared = ws.spark.sparkContext.broadcast(cuts)
    names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]

    def slices(batches):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("url_key", "capture_ts", "page_id")), strict=True)
            where = [bisect.bisect_right(shared.value, (u, t, -1 if p is None else p)) for u, t, p in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], [*batch.schema.names, "slice"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("nth", "ascending")])  # a slice of a run comes in the run's own order
        run = table.column("run").to_pylist()
        page = [-1 if p is None else p for p in table.column("page_id").to_pylist()]
        keys = list(zip(table.column("url_key").to_pylist(), table.column("capture_ts").to_pylist(), page, table.column("path").to_pylist(), table.column("offset").to_pylist(), range(len(run)), strict=True))
        bounds = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]
        order = [key[-1] for key in LoserTree([itertools.islice(keys, a, b) for a, b in itertools.pairwise(bounds)])]
        merged = table.select(keep).take(pa.array(order, pa.int64()))
        return merged.add_column(1, "place", pa.array(range(len(order)), pa.int64()))

    keep = ["slice", "url_key", "capture_ts", "page_id", "url", "record_type", "refers_to", "path", "offset", "length"]
    ddl = "slice int, place long, url_key string, capture_ts long, page_id long, url string, record_type string, refers_to long, path string, offset long, length long"
    sliced = runs.mapInArrow(slices, RUN_SCHEMA + ", slice int").select(*names, "slice")
    merged = ws.save(sliced.groupBy("slice").applyInArrow(merge, ddl), "index")
    sizes, offsets, at = merged.groupBy("slice").count().orderBy("slice").collect(), [], 0  # a row a slice
    for s in sizes:
        offsets.append((s["slice"], at))
        at += s["count"]
    starts = F.broadcast(ws.spark.createDataFrame(offsets, "slice int, before long"))
    return merged.join(starts, "slice").withColumn("capture_rank", F.col("before") + F.col("place")).drop("before", "place", "slice")


def read_archives(ws: Workspace, index: DataFrame) -> DataFrame:
    """Read every record that the merged index names, at its path, offset and length, and resolve revisits to their response's payload.

    Records are dealt out by stretches of READ_BYTES of an archive; the number of tasks follows from the bytes that the index counts.
    """
    folder = f"{ws.base}/archives"
    held = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(ws.spark.sparkContext.defaultParallelism, -(-held // TASK_BYTES))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    places = index.select("path", "offset", "length", "page_id", "record_type", "url_key", "capture_ts", "capture_rank").repartition(tasks, "path", stretch).sortWithinPartitions("path", "offset")
    records = ws.save(places.mapInArrow(_reader(folder), RECORD_SCHEMA), "records")
    full = records.filter("record_type = 'response'").select(F.col("page_id").alias("ref"), F.col("payload_bytes").alias("ref_bytes"))
    first = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("ref")).distinct()
    full = ws.save(full.join(first, "ref", "left_semi").groupBy("ref").agg(F.max("ref_bytes").alias("ref_bytes")), "referred")
    return (
        records.join(full, records["refers_to"] == full["ref"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "ref_bytes"))
        .drop("ref", "ref_bytes")
    )


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Write pages as WARC archives, merge their capture index, and read the archives back.

    Of pages with equal payloads of at least `min_payload` bytes the one with the smallest id becomes a response, the
    others revisit it; smaller payloads and pages without an id are always responses. A null html is an
    empty payload, a null URL an empty one. Pages that repeat the smallest id are all responses. A capture's timestamp is derived from
    its id, since pages carry none. Columns other than the three are ignored; an empty table gives two empty ones.

    Returns (records, index): what the archives hold (page_id, record_type, refers_to, payload_bytes, payload_digest,
    url, path, offset, and url_key, capture_ts and capture_rank of the index through which they were read), and the captures ordered by (url_key, capture_ts, page_id) with their capture_rank.
    """
    ws = Workspace(pages.sparkSession, "warc")
    runs = write_archives(ws, pages, id_col, url_col, html_col, min_payload)
    index = merge_index(ws, runs)
    return read_archives(ws, index), index
