"""Sinks: the archive of requests and responses (as Parquet, and as WARC files), queue and state tables."""

from __future__ import annotations

import gzip
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def archive(responses: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Append (url, fetched_at, ...) by date, with bounded files."""
    dated = responses.withColumn("date", F.to_date("fetched_at"))
    dated.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("date").parquet(path)


def forward(links: DataFrame, path: str, me: int = -1) -> None:
    """Append links (owner, url, depth) to their owners' inboxes; those of this node (me) and without an owner (-1) aren't sent."""
    links.where((F.col("owner") >= 0) & (F.col("owner") != me)).write.mode("append").partitionBy("owner").parquet(path)


def warc_record(url: str, date: str, body: bytes, kind: str = "response") -> bytes:
    """One WARC/1.1 record, a request or a response, as a gzip member."""
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {url} {date}')}>\r\n"
        f"Content-Type: application/http;msgtype={kind}\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + body + b"\r\n\r\n", mtime=0)


class WarcSink(DataSource):
    """Rows (url string, date string, body binary[, request binary]) as .warc.gz files that rotate at max_bytes.

    Option path: a folder that all executors share. A task writes under names
    that start with a dot; the commit of the job gives the files of the tasks
    that count their names, so that a task that ran twice leaves one set.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "url string, date string, body binary, request binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _WarcWriter(self.options)


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]


class _WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("max_bytes", str(1 << 30)))

    def write(self, rows) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        names: list[str] = []
        out, held = None, 0
        try:
            for row in rows:
                own = row.asDict()
                pair = [("request", own.get("request")), ("response", own["body"])]
                records = [warc_record(own["url"], own["date"], bytes(b), kind) for kind, b in pair if b is not None]
                if out is None or held + sum(map(len, records)) > self.most:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, held = open(f"{self.path}/.{names[-1]}", "wb"), 0  # noqa: SIM115
                for record in records:
                    out.write(record)
                    held += len(record)
        finally:
            if out:
                out.close()
        return _Written(tuple(names))

    def commit(self, messages) -> None:
        for name in (n for m in messages if m for n in m.files):
            os.replace(f"{self.path}/.{name}", f"{self.path}/{name}")

    def abort(self, messages) -> None:
        for name in (n for m in messages if m for n in m.files):
            if os.path.exists(f"{self.path}/.{name}"):
                os.remove(f"{self.path}/.{name}")
