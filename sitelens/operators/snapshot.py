"""A site's identity: one digest over all its pages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def snapshots(rows: DataFrame) -> DataFrame:
    """(site, row) to (site, pages, snapshot): SHA-256 of v1 and the site's rows in order, each ended by NUL.

    The digest is fed row by row behind a sort that spills, so no row, group or
    Python value holds a site; that one site's bytes pass one task is the nature
    of SHA-256. Null rows count as pages only; a site of null rows has no digest.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, pages, told, h = None, 0, False, None
        end = lambda: pa.RecordBatch.from_pydict({"site": pa.array([site], pa.string()), "pages": pa.array([pages], pa.int64()), "snapshot": pa.array([h.hexdigest() if told else None], pa.string())})
        for b in batches:
            for s, row in zip(b["site"], b["row"], strict=True):
                if h is None or s.as_py() != site:
                    if h is not None:
                        yield end()
                    site, pages, told, h = s.as_py(), 0, False, hashlib.sha256(b"v1\0")
                pages += 1
                if row.is_valid:
                    told = True
                    h.update(row.as_buffer())
                    h.update(b"\0")
        if h is not None:
            yield end()

    return rows.repartition("site").sortWithinPartitions("site", "row").mapInArrow(digests, "site string, pages long, snapshot string")
