"""WARC records in ZIP packages: write them, and range-read records through the package's own directories.

A package stores ``records.warc`` and ``index.cdxj`` without compression. It
is one row of a Parquet table in the shared folder, so any reader of the
cluster can open it. The reader finds the end record, follows the ZIP64 end
record and central directory to the members, reads the index and then each
record by offset and length; nothing is unpacked.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored

MIN_REVISIT_BYTES = 1000
PACKAGE_BYTES = 4_000_000
RECORDS, INDEX = "records.warc", "index.cdxj"
PACKAGE_TYPE = "package string, data binary"
RECORD_TYPE = ("id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, "
               "payload binary, package string, offset long, length long")


def warc_record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    body = b"" if refers_to is not None else payload
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(head) + len(body)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + head + body + b"\r\n\r\n"


def package(records: list[bytes]) -> bytes:
    """A ZIP of the records and their index, both stored; sizes in ZIP64 fields."""
    index, at = [], 0
    for i, r in enumerate(records):
        index.append(json.dumps({"record": i, "offset": at, "length": len(r)}))
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((RECORDS, records), (INDEX, ["\n".join(index).encode()])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                for p in parts:
                    f.write(p)
    return out.getvalue()


def members(data: memoryview) -> dict[str, tuple[int, int]]:
    """(offset, length) of the stored members, from the central directory; ZIP64 values where the short ones overflow."""
    tail = bytes(data[-65_557:])
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("not a ZIP package: no end record")
    count, _, start = struct.unpack_from("<HII", tail, end + 10)
    end += len(data) - len(tail)
    if (count == 0xFFFF or start == 0xFFFFFFFF) and end >= 20 and bytes(data[end - 20:end - 16]) == b"PK\6\7":
        big = struct.unpack_from("<Q", data, end - 12)[0]
        count, _, start = struct.unpack_from("<QQQ", data, big + 32)
    found = {}
    for _ in range(count):
        if bytes(data[start:start + 4]) != b"PK\1\2":
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", data, start + 10)[0]
        packed, plain, n, x, c = struct.unpack_from("<IIHHH", data, start + 20)
        local = struct.unpack_from("<I", data, start + 42)[0]
        name = bytes(data[start + 46:start + 46 + n]).decode()
        at, stop = start + 46 + n, start + 46 + n + x
        while at + 4 <= stop:
            kind, size = struct.unpack_from("<HH", data, at)
            if kind == 1:
                spot = at + 4
                if plain == 0xFFFFFFFF:
                    plain, spot = struct.unpack_from("<Q", data, spot)[0], spot + 8
                if packed == 0xFFFFFFFF:
                    packed, spot = struct.unpack_from("<Q", data, spot)[0], spot + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", data, spot)[0]
            at += 4 + size
        if method == 0:
            ln, lx = struct.unpack_from("<HH", data, local + 26)
            found[name] = (local + 30 + ln + lx, plain)
        start += 46 + n + x + c
    return found


def parse_record(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return page(fields["WARC-Record-ID"]), fields["WARC-Type"], refers, fields["WARC-Target-URI"], digest, size, payload


def write_packages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                   min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(package, data) with a record per row, written under the shared folder.

    Of rows with equal payloads of at least ``min_revisit`` bytes the largest
    key is the response and the others refer to it. Null html is an empty
    payload, a null URL an empty target; rows with a null key can't be named
    in a record and are left out; equal keys with equal payloads are all
    responses or all revisits. An empty table gives no packages; other columns
    are ignored.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    src = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("body")).filter("id is not null")
    src = src.withColumns({"digest": F.sha1("body"), "n": F.octet_length("body")})
    first = src.filter(F.col("n") >= min_revisit).groupBy("digest", "n").agg(
        F.max("id").alias("rep"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    todo = src.join(first, ["digest", "n"], "left")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row() -> pd.DataFrame:
            data = package(records)
            return pd.DataFrame({"package": [hashlib.sha1(data).hexdigest()[:16] + ".zip"], "data": [data]})

        records, size = [], 0
        for pdf in batches:
            for i, u, b, d, rep in zip(pdf["id"], pdf["url"], pdf["body"], pdf["digest"], pdf["rep"], strict=True):
                refers = None if pd.isna(rep) or int(rep) == i else int(rep)
                records.append(warc_record(int(i), u, b, d, refers))
                size += len(records[-1])
                if size >= PACKAGE_BYTES:
                    yield row()
                    records, size = [], 0
        if records:
            yield row()

    return stored(todo.mapInPandas(packed, PACKAGE_TYPE), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record, read by its range in the package; a revisit has an empty payload."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["package"], pdf["data"], strict=True):
                data = memoryview(raw)
                found = members(data)
                at, n = found[INDEX]
                base = found[RECORDS][0]
                rows = []
                for line in bytes(data[at:at + n]).decode().splitlines():
                    x = json.loads(line)
                    spot = base + x["offset"]
                    rows.append((*parse_record(bytes(data[spot:spot + x["length"]])), name, spot, x["length"]))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_TYPE.split(", ")])
                out["refers_to"] = out["refers_to"].astype("Int64")
                yield out

    return packages.mapInPandas(read, RECORD_TYPE)
