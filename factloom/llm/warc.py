"""WARC (10): write captures as WARC/1.1 archives, read them back, and assemble each transaction.

Every page becomes three records: a request, a response (or a revisit of an earlier equal payload) and a metadata
record; request and metadata name the response in WARC-Concurrent-To. Reading parses records by Content-Length, checks
each payload against its SHA-1, joins the records of a capture through their concurrent-to identifiers and emits one
nested row per capture.

Equal payloads of at least `min_bytes`: the largest page_id is the response, the others revisit it; smaller payloads
are all responses. Null html: an empty payload. Null page_id: a response unless another id holds its payload, in which
case it revisits that. Rows repeated with the same id and payload share one decision and are captures of their own.
Control characters in urls are percent-encoded; null urls become an urn. Empty table: no archive, empty result.

Archives go to the shared folder through Spark's text sink (gzip), which commits whole files only; a file holds about
`file_bytes` of payload, so reading one never needs more memory than that.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import discard, fresh_path, materialize, rows, spread_lookup, table

MIN_BYTES, FILE_BYTES = 1000, 16 << 20
END = "\r\n\r\n"
RECORD = "record_id string, concurrent_to string, kind string, url string, refers_to string, payload_digest string, payload_bytes long, fields string, payload binary"


def decisions(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """page_id, sha, record_type, refers_to for every distinct (page_id, payload); and the payloads' table."""
    each = materialize(pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("long").alias("n_bytes")), "payloads")
    groups = materialize(each.filter(F.col("n_bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("size")), "payload-groups")
    joined = spread_lookup(each.distinct(), groups, ["sha"], "size", each.count(), F.col("page_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")), each


def _record(kind: str, ident: str, url: str, date: str, headers: list[tuple[str, str]], body: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(body)}"]
    return "\r\n".join(lines) + END + body.decode()


def _safe(url: str | None) -> str:
    return "urn:no-url" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _capture(page_id, url, html, sha, record_type, refers_to, nth: int, date: str):
    """The three records of one page."""
    base, url, payload = f"urn:capture:{'none' if page_id is None else page_id}:{sha[:16]}", _safe(url), (html or "").encode()
    own = f"{base}:{nth}:response"
    digest = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode())
    path = re.sub(r"^[a-z]+://[^/]*", "", url) or "/"
    yield _record("request", f"{base}:{nth}:request", url, date, [("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1{END}".encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    http = ("Content-Type", "application/http;msgtype=response")
    if record_type == "revisit":
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record("revisit", own, url, date, [http, digest, profile, ("WARC-Refers-To", f"<urn:capture:{refers_to}:{sha[:16]}:0:response>")], head)
    else:
        yield _record("response", own, url, date, [http, digest], head + payload)
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    yield _record("metadata", f"{base}:{nth}:metadata", url, date, [("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/warc-fields")], fields)


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write page_id, url, html as gzip WARC files under `path`."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    decided, each = decisions(pages, min_bytes)
    files = max(1, -(-(each.agg(F.sum("n_bytes")).first()[0] or 0) // file_bytes))
    key = F.coalesce(F.col("page_id"), F.xxhash64("sha"))
    a = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("__at", key)
    b = decided.withColumn("__at", key).withColumnsRenamed({"page_id": "__id", "sha": "__sha"})
    joined = a.repartition(files, "__at").join(b.repartition(files, "__at"), (a["__at"] == b["__at"]) & a["page_id"].eqNullSafe(b["__id"]) & (a["sha"] == b["__sha"]), "left")

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "record_type", "refers_to")), strict=True):
                key = f"{row[0]}:{row[3]}"
                nth = seen[key] = seen.get(key, -1) + 1
                out += _capture(*row, nth, date)
                if len(out) > 3000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                    out = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    joined.select("page_id", "url", "html", "sha", "record_type", "refers_to").mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)
    discard(each)


def parse_records(data: bytes):
    """(headers, body) of each record of an archive's bytes, by Content-Length."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where its Content-Length says")
        at += 4


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under `path`."""

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        bare = lambda x: x.strip("<>") if x else None
        for b in batches:
            for content in b.column("content"):
                out = {n: [] for n in names}
                for h, body in parse_records(gzip.decompress(content.as_py())):
                    kind, payload, fields = h["WARC-Type"], None, None
                    digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex() if "WARC-Payload-Digest" in h else None
                    n_bytes = None
                    if kind in ("response", "revisit"):
                        head, _, payload = body.partition(b"\r\n\r\n")
                        n_bytes = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        if kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                        payload = payload if kind == "response" else None
                    elif kind == "metadata":
                        fields = body.decode()
                    row = (bare(h["WARC-Record-ID"]), bare(h.get("WARC-Concurrent-To")), kind, h.get("WARC-Target-URI"), bare(h.get("WARC-Refers-To")), digest, n_bytes, fields, payload if with_payload else None)
                    for n, v in zip(names, row, strict=True):
                        out[n].append(v)
                    if len(out["kind"]) > 3000:
                        yield rows(out, schema)
                        out = {n: [] for n in names}
                yield rows(out, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, page_id, and the request, response (or revisit) and metadata as structs.
    A record belongs to the capture whose response it names in concurrent-to; a response names itself."""
    of = F.coalesce(F.col("concurrent_to"), F.col("record_id"))
    pick = lambda cond, *cols: F.max(F.when(cond, F.struct(*cols)))
    kind = F.col("kind")
    out = records.groupBy(of.alias("capture_id")).agg(
        pick(kind == "request", "record_id", "url").alias("request"),
        pick(kind.isin("response", "revisit"), "record_id", "kind", "url", "refers_to", "payload_digest", "payload_bytes", "payload").alias("response"),
        pick(kind == "metadata", "record_id", "fields").alias("metadata"),
    )
    page = F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1)
    return out.withColumn("page_id", F.when(page != "", page.cast("long")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_records(spark, path, with_payload=False))
    refers = F.regexp_extract("response.refers_to", r"^urn:capture:(-?\d+):", 1)
    return captures.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"))


ORACLE = {
    "op10_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
}
QUERIES = {"op10_warc": op10_warc}
