"""Captured sites as a data source: a partitioned reader and a writer with commit and abort.

A site is a folder with page files, robots.txt and records ``_capture*.json`` that
list them; what no record lists isn't there. Tasks write page files under names
of their own attempt and records under hidden names; committing renames the
records, so a failed or repeated attempt leaves nothing visible. A site may have
many records, one for each task that wrote some of its pages, and each is a
partition of its own when read. Files go through pyarrow's file systems, so
roots may be file://, hdfs:// or s3:// URIs that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import urls as U

SCHEMA = (
    "slug string, site string, file string, url string, status_code int, content_type string, is_entry boolean, elapsed_ms long, html string, robots_status int, robots_txt string"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_LISTED = ("file", "url", "status_code", "content_type", "is_entry", "elapsed_ms")
#: Record files read by one task.
BATCH = 16


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if ":" in root else f"file://{root}")


def _text(files: pafs.FileSystem, path: str) -> str | None:
    """A file's text, null where there is none."""
    try:
        with files.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def _put(files: pafs.FileSystem, path: str, text: str) -> None:
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as f:
        f.write(text.encode())


@dataclass
class Records(InputPartition):
    paths: tuple[str, ...]


class CaptureReader(DataSourceReader):
    """The driver lists record files; tasks read them, their pages and robots.txt."""

    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.root)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(f.path for f in found if f.type == pafs.FileType.File and f.base_name.startswith("_capture") and f.base_name.endswith(".json"))
        return [Records(tuple(paths[i : i + BATCH])) for i in range(0, len(paths), BATCH)] or [Records(())]

    def read(self, partition: Records) -> Iterator[tuple]:
        files, _ = _open(self.root)
        for path in partition.paths:
            folder = path.rsplit("/", 1)[0]
            record = json.loads(_text(files, path) or "{}")
            robots = _text(files, f"{folder}/robots.txt")
            head, tail = (record.get("slug") or folder.rsplit("/", 1)[-1], record.get("url")), (record.get("robots_status"), robots)
            # a site that gave no page is a row without one
            for page in record.get("pages") or [{}]:
                url = page.get("url", page.get("final_url"))
                html = _text(files, f"{folder}/{page['file']}") if page.get("file") else None
                yield (*head, page.get("file"), url, page.get("status_code", page.get("status")), page.get("content_type"), page.get("is_entry"), page.get("elapsed_ms"), html, *tail)


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt left: hidden records and the names they get."""

    records: tuple[tuple[str, str], ...]
    attempt: str
    folders: tuple[str, ...]


class CaptureWriter(DataSourceArrowWriter):
    """Rows in the source's schema to site folders; see the module for how they become visible."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.root)
        attempt, sites = uuid.uuid4().hex, {}
        for batch in iterator:
            for row in batch.to_pylist():
                site = sites.setdefault(row["slug"], {"slug": row["slug"], "url": row["site"], "robots_status": row["robots_status"], "pages": []})
                if row["robots_txt"] is not None and "robots" not in site:
                    _put(files, f"{root}/{row['slug']}/robots.txt", row["robots_txt"])
                    site["robots"] = True
                if any(row[k] is not None for k in _LISTED):
                    # numbered, as a site may have a URL twice
                    listed = {k: row[k] for k in _LISTED} | {"file": row["file"] and f"{attempt}/{len(site['pages'])}-{row['file']}"}
                    if row["html"] is not None:
                        _put(files, f"{root}/{row['slug']}/{listed['file']}", row["html"])
                    site["pages"].append(listed)
        records = []
        for slug, site in sites.items():
            hidden = f"{root}/{slug}/.{attempt}.json"
            _put(files, hidden, json.dumps({k: v for k, v in site.items() if k != "robots"}))
            records.append((hidden, f"{root}/{slug}/_capture-{attempt}.json"))
        return Written(tuple(records), attempt, tuple(f"{root}/{slug}" for slug in sites))

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.root)
        for message in messages:
            for hidden, name in message.records if message else ():
                files.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        """What finished attempts wrote goes; records of attempts that died stay hidden."""
        files, _ = _open(self.root)
        for message in messages:
            if message:
                for hidden, _name in message.records:
                    files.delete_file(hidden)
                for folder in message.folders:
                    if files.get_file_info(f"{folder}/{message.attempt}").type != pafs.FileType.NotFound:
                        files.delete_dir(f"{folder}/{message.attempt}")


class CaptureSource(DataSource):
    """``format("site_capture")``; the path is the root folder."""

    @classmethod
    def name(cls) -> str:
        return "site_capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:  # noqa: ANN001
        return CaptureReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> CaptureWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("a capture is only added to")
        return CaptureWriter(self.options["path"])


def local_links(html: Column, url: Column) -> Column:
    """Anchors on the page's own host become root-relative, the rest stays as written."""
    own = F.regexp_replace(U.bare_host(U.host(url)), "([.+])", "\\\\$1")
    anchor = F.concat(F.lit("(?i)(<a\\b[^>]*?\\bhref=[\"'])https?://(?:www[.])?"), own, F.lit("(?=[/?#\"'])(?:(?=[?#\"'])|)([^\"']*[\"'])"))
    rooted = F.regexp_replace(F.coalesce(html, F.lit("")), anchor, F.lit("$1\u0001$2"))
    # a link to the bare host gets the root's slash
    return F.regexp_replace(F.regexp_replace(rooted, "\u0001(?=/)", ""), "\u0001", "/")


def captured(pages: DataFrame, robots: DataFrame | None = None, localize: bool = True) -> DataFrame:
    """Pages (url, html, and status_code, content_type, is_entry, elapsed_ms where there are) as rows of the source; ``robots``: slug, robots_status, robots_txt.

    Bodies get S12's local links unless ``localize`` is false; pages without a host go to the site "_".
    """
    have = set(pages.columns)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    given = lambda c, default: F.col(c) if c in have else F.lit(default).cast(kinds[c]).alias(c)
    url = F.col("url")
    rows = pages.select(
        F.when(U.slug(url) == "", "_").otherwise(U.slug(url)).alias("slug"), F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("site"), U.local_path(url).alias("file"), url, given("status_code", 200),
        given("content_type", "text/html"), given("is_entry", None), given("elapsed_ms", None), F.when(F.col("html").isNotNull(), local_links(F.col("html"), url) if localize else F.col("html")).alias("html"),
    )
    # two URLs may want one name
    name = F.concat(F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 12), F.lit("-"), F.substring(F.regexp_replace("file", "/", "_"), -150, 150))
    rows = rows.withColumn("file", F.when(F.col("html").isNotNull(), name))
    if robots is None:
        return rows.withColumns({"robots_status": F.lit(None).cast("int"), "robots_txt": F.lit(None).cast("string")}).select(*_NAMES)
    return rows.join(robots.select("slug", "robots_status", "robots_txt"), "slug", "left").select(*_NAMES)


def write(rows: DataFrame, root: str, salts: int = 16) -> None:
    """Rows of the source, a site's dealt to as many tasks as it needs by salts of the URL; neighbours share a record."""
    rows.sparkSession.dataSource.register(CaptureSource)
    counted = rows.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(salts)))
    counted.repartition("slug", "_salt").drop("_salt").write.format("site_capture").mode("append").save(root)


def read(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.read.format("site_capture").load(root)


def robots_of(capture: DataFrame) -> DataFrame:
    """One robots body per site: site_id (the slug), robots_txt, robots_status."""
    return capture.groupBy(F.col("slug").alias("site_id")).agg(F.max("robots_txt").alias("robots_txt"), F.max("robots_status").alias("robots_status"))
