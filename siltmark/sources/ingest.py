"""Incremental ingestion: window queries, new-file detection, end-to-end ingest."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.config import Feature
from siltmark.operators.harmonize import harmonize
from siltmark.operators.model import score_batch
from siltmark.sources.files import DELIMITED, JSON, not_utf8, read_any, read_delimited, read_json_any
from siltmark.sources.partitions import write_partitioned
from siltmark.sources.workspace import workspace

LEDGER_SCHEMA = "path string, hash string, processed_at timestamp, row_count long"


#: What a parameter's name may stand in without being one: literals, quoted names, comments and casts.
_SQL_PARTS = re.compile(
    r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:(?P<name>[A-Za-z_]\w*)", re.S
)


def bind_literals(sql: str, args: Mapping[str, str]) -> str:
    """``sql`` with ``:name`` as a quoted literal for each of ``args``; literals, quoted names and comments stay as they are."""
    def literal(m: re.Match) -> str:
        if m["name"] not in args:
            return m[0]
        return "'" + args[m["name"]].replace("'", "''") + "'"

    return _SQL_PARTS.sub(literal, sql)


def _moment(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def read_window_query(
    spark: SparkSession,
    sql: str,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    jdbc: Mapping[str, str] | None = None,
    hours: int = 6,
    slices: int = 1,
) -> DataFrame:
    """Run ``sql`` with ``:window_start`` and ``:window_end`` bound; default the last 6 hours.

    The query reads temp views or catalogue tables; with ``jdbc`` options it is sent to that database, with the
    parameters as quoted literals. A database hands a query's rows to one task, so a long window may be cut in ``slices``
    of equal length, each a query and a task of its own. That holds for queries that select rows of a half-open
    window; a query that aggregates over its window needs ``slices=1``.
    """
    last = end or datetime.now(timezone.utc)
    first = start or _moment(last) - timedelta(hours=hours)
    bounds = [first, last]
    if slices > 1:
        a, b = _moment(first), _moment(last)
        bounds = [first, *[a + (b - a) * k / slices for k in range(1, slices)], last]
    texts = [v.isoformat(sep=" ") if isinstance(v, datetime) else str(v) for v in bounds]
    parts = []
    for a, b in zip(texts, texts[1:]):
        args = {"window_start": a, "window_end": b}
        if jdbc is None:
            parts.append(spark.sql(sql, args=args))
        else:
            parts.append(spark.read.format("jdbc").options(**jdbc).option("query", bind_literals(sql, args)).load())
    return reduce(DataFrame.unionAll, parts)


def list_files(spark: SparkSession, pattern: str, content_hash: bool = True) -> DataFrame:
    """``path, uri, hash, header``: executors read and hash the files; ``header`` is a hash of the first line.

    ``uri`` is the encoded name that readers report, ``path`` the plain one. Files are whole values in one
    row (Spark's limit is 2 GB per file). With ``content_hash=False`` length and modification time stand in for
    the content and no byte is read; then every file is a reading group of its own.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    )
    names = [F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("_metadata.file_path").alias("uri")]
    if not content_hash:
        stamp = F.md5(F.concat_ws("|", "length", "modificationTime"))
        return files.select(*names, stamp.alias("hash"), F.md5("path").alias("header"))
    line = F.rtrim(F.substring_index(F.decode("content", "ISO-8859-1"), "\n", 1))
    return files.select(*names, F.md5("content").alias("hash"), F.md5(line).alias("header"))


def ingest_new_files(
    spark: SparkSession,
    pattern: str,
    ledger: DataFrame | None = None,
    now: datetime | None = None,
    content_hash: bool = True,
    by: str = "path",
) -> tuple[DataFrame | None, DataFrame]:
    """``(rows, ledger)``: rows of files that are new or changed, and the ledger after.

    A file counts as done when the ledger has its path with the same hash, or, ``by="content"``, when it has the hash
    under any path; of files with equal content in one pass the first path is read then. Files sharing format and header are
    read by one scan into a table in the shared folder, so every file is parsed once and wholly. Where a group
    cannot be read (clashing types, a damaged file, a malformed line), its halves are read apart, and a single file that
    still fails is warned about, gives no rows and stays out of the ledger, so it is tried again. ``rows`` is None
    when nothing is new.
    """
    known = ledger if ledger is not None else spark.createDataFrame([], LEDGER_SCHEMA)
    fresh = list_files(spark, pattern, content_hash)
    if by == "content":
        once = fresh.groupBy("hash").agg(F.min(F.struct("path", "uri", "header")).alias("_f")).select("hash", "_f.*")
        fresh = once.join(known.select("hash"), "hash", "left_anti")
    else:
        fresh = fresh.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
    todo = fresh.collect()  # names and hashes of new files: what the readers need to be opened
    groups: dict[tuple[str, str], list[str]] = {}
    for r in todo:
        kind = r["path"].rsplit(".", 1)[-1].lower()
        groups.setdefault((kind, r["header"] if kind in DELIMITED else ""), []).append(r["path"])
    parts = [part for (kind, _), paths in groups.items() for part in _read_group(spark, kind, paths)]
    if not parts:
        return None, known
    rows = parts[0]
    for p in parts[1:]:
        rows = union_widened(rows, p)
    moment = F.lit((now or datetime.now(timezone.utc)).isoformat()).cast("timestamp")
    seen = rows.groupBy("_uri").agg(F.count(F.lit(1)).alias("row_count"))
    hashes = spark.createDataFrame([(r["path"], r["uri"], r["hash"]) for r in todo], "path string, uri string, hash string")
    done = seen.join(hashes, seen["_uri"] == hashes["uri"]).select(
        "path", "hash", moment.alias("processed_at"), "row_count"
    )
    kept = known if by == "content" else known.join(done.select("path"), "path", "left_anti")
    return rows.drop("_uri"), kept.unionByName(done)


def union_widened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column whose types have no common one becomes text on both sides."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    clash = [
        c for c in left.keys() & right.keys()
        if left[c] != right[c] and not (left[c] in numbers and right[c] in numbers)
    ]
    text = {c: F.col(f"`{c}`").cast("string") for c in clash}
    return a.withColumns(text).unionByName(b.withColumns(text), allowMissingColumns=True) if clash else a.unionByName(
        b, allowMissingColumns=True
    )


def _read_group(spark: SparkSession, kind: str, paths: list[str]) -> list[DataFrame]:
    """The group as written tables with ``_uri``; by halves where the group fails, none of a file that fails."""
    if kind not in (*DELIMITED, *JSON, "parquet"):
        warnings.warn(f"unsupported format {kind!r}: {len(paths)} file(s) skipped", stacklevel=3)
        return []
    try:
        sets = [paths]
        if kind in DELIMITED:  # files of one header may differ in encoding
            odd = {r["uri"] for r in not_utf8(spark, paths).collect()}
            uris = {p: u for p, u in spark.read.format("binaryFile").load(paths).select(
                F.regexp_replace("path", "^file:/+", "/"), "_metadata.file_path").collect()} if odd else {}
            sets = [[p for p in paths if uris.get(p) not in odd], [p for p in paths if uris.get(p) in odd]]
        out = []
        for k, part in enumerate(sets):
            if not part:
                continue
            if kind in DELIMITED:
                df = read_delimited(spark, part, encoding=("UTF-8", "ISO-8859-1")[k])
            elif kind in JSON:
                df = read_json_any(spark, part)
            else:
                df = spark.read.option("mergeSchema", True).parquet(*part)
            if not df.columns:
                continue
            staged = workspace(spark, "ingest")
            df.withColumn("_uri", F.col("_metadata.file_path")).write.parquet(staged)
            out.append(spark.read.parquet(staged))
        return out
    except Exception as e:  # an unreadable file must not stop the others
        if len(paths) > 1:  # halves: a few bad files among n cost some log2(n) jobs each, the rest stay together
            middle = len(paths) // 2
            return [part for half in (paths[:middle], paths[middle:]) for part in _read_group(spark, kind, half)]
        warnings.warn(f"{paths[0]} skipped: {str(e)[:200]}", stacklevel=3)
        return []


@dataclass
class IngestResult:
    status: str
    record_count: int
    sources: list[str] = field(default_factory=list)
    saved: str = ""
    sample: list[dict] = field(default_factory=list)
    ledger: DataFrame | None = None


def ingest(
    spark: SparkSession,
    source: str | DataFrame,
    mapping: Mapping[str, Any] | str,
    features: Iterable[Feature],
    out: str,
    model: PipelineModel | None = None,
    model_version: str = "v1",
    ledger: DataFrame | None = None,
    batch_time: datetime | str | None = None,
    now: datetime | str | None = None,
    time_col: str | None = None,
) -> IngestResult:
    """Extract, harmonize, optionally score, append to the partitioned log.

    ``source``: a DataFrame (records or a window query), a glob (read
    incrementally against ``ledger``) or one file. The harmonized rows are staged once in the
    shared folder; count, sample and the log come from there. ``sources`` names the processed files.
    """
    features = list(features)
    after = ledger
    if isinstance(source, DataFrame):
        raw, names = source, ["records"]
    elif any(c in source for c in "*?["):
        before = ledger if ledger is not None else spark.createDataFrame([], LEDGER_SCHEMA)
        raw, after = ingest_new_files(spark, source, ledger)
        names = [r["path"] for r in after.join(before, ["path", "hash"], "left_anti").select("path").orderBy("path").collect()]
    else:
        raw, names = read_any(spark, source), [source]
    if raw is None:
        return IngestResult("NO_NEW_DATA", 0, ledger=after)
    clean = harmonize(raw, mapping, features, now)
    if model is not None:
        clean = score_batch(clean, model, model_version)
    staged = workspace(spark, "harmonized")
    clean.write.parquet(staged)
    clean = spark.read.schema(clean.schema).parquet(staged)
    count = clean.count()
    if not count:
        return IngestResult("NO_NEW_DATA", 0, ledger=after)
    path = write_partitioned(clean, out, batch_time, time_col)
    sample = [r.asDict() for r in clean.limit(3).collect()]
    return IngestResult("SUCCESS", count, names, path, sample, after)
