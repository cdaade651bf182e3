"""Reading and writing the layers: raw text, bronze, silver and gold tables under one root.

Tables are Parquet, laid out by ``snapshot_date``; the month is a directory, so a date window
prunes files. A re-run replaces its own months only, and readers see each of them as it was or as
it is (see ``published``).
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lendscape import schemas as S
from lendscape.functions.dates import shift_months
from lendscape.plans import gold, silver
from lendscape.session import no_shuffle_kept
from lendscape.sources import published
from lendscape.sources.published import PERIOD

FIRST_MONTH = date(2023, 1, 1)
LAST_MONTH = date(2025, 11, 1)


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files below a path, those with one header together. Reads one line of each file; files without a line go."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[str, list[str]] = {}
    for status in fs.globStatus(place) or []:
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext():
            at = files.next().getPath()
            inner = at.toString().removeprefix(status.getPath().toString())
            if any(part.startswith(("_", ".")) for part in inner.split("/")):
                continue
            codec, stream = codecs.getCodec(at), fs.open(at)
            try:
                text = codec.createInputStream(stream) if codec else stream
                header = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
            finally:
                stream.close()
            if header is not None:
                found.setdefault(header, []).append(at.toString())
    return list(found.values()) if len(found) > 1 else [[path]]


def read_raw(spark: SparkSession, paths: str | Sequence[str], table: str) -> DataFrame:
    """Raw CSV with headers, every column text: no inference pass over the files.

    Columns are found by name in each file's own header, in whatever order; the files of a folder may differ. Absent
    columns are null, unknown ones are ignored. There is one scan for each different header.
    """
    known = list(S.TABLES[table])
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        for files in _by_header(spark, path):
            part = spark.read.option("header", True).csv(files)
            if not set(known) & set(part.columns):
                raise ValueError(f"no column of {table} in the header of {files[0]}")
            parts.append(part.select([F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in known]))
    return append_months(parts)


def path_of(root: str, layer: str, table: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{table}"


def read_table(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame:
    """All published months of one table, none of them left or not; an error that says what to run if there never were any.

    A folder without a manifest is read as plain Parquet.
    """
    path = path_of(root, layer, table)
    found = published.read(spark, path)
    if found is not None:
        return found
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no {layer} data at {path}: run the stage that writes it first") from missing


def in_window(start: date, end: date, column: str = PERIOD) -> Column:
    """Inclusive date window, compared as dates so that it prunes partitions."""
    return F.col(column).between(F.lit(start), F.lit(end))


def load_window(spark: SparkSession, root: str, start: date = FIRST_MONTH, end: date = LAST_MONTH) -> tuple[DataFrame, ...]:
    """The four silver tables clipped to a window: loans, clickstream, attributes, financials."""
    names = ("loans", "clickstream", "attributes", "financials")
    return tuple(read_table(spark, root, "silver", t).filter(in_window(start, end)) for t in names)


def write_table(df: DataFrame, path: str, months: Iterable[date] = ()) -> dict:
    """Replace the months ``df`` holds, and empty those of ``months`` that it does not; returns what was observed."""
    return published.write(df, path, months)


def rows_of(spark: SparkSession, path: str, months: Iterable[date]) -> int:
    """Rows a table has in some months: counted from the files' footers, 0 where nothing was ever written."""
    found = published.read(spark, path)
    return 0 if found is None else found.filter(F.col(PERIOD).isin(list(months))).count()


def of_months(df: DataFrame, months: Iterable[date]) -> DataFrame:
    """Rows of the given months; text dates are compared as dates."""
    return df.filter(F.col(PERIOD).try_cast("date").isin(list(months)))


def _observed(layer: str, table: str, metrics: dict) -> dict:
    return {"layer": layer, "table": table, **metrics}


def land_bronze(raw: DataFrame, root: str, table: str, months: Sequence[date]) -> dict:
    """Land the months of one source as received. One pass over the source, however many months. Returns the load's metrics."""
    day = F.col(PERIOD).try_cast("date").alias(PERIOD)
    landed = of_months(raw, months).select(*[c for c in raw.columns if c != PERIOD], day)
    return _observed("bronze", table, write_table(landed, path_of(root, "bronze", table), months))


def _raw_or_none_yet(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Bronze, without rows where a table has no month."""
    try:
        return read_table(spark, root, "bronze", table)
    except FileNotFoundError:
        return spark.createDataFrame([], S.raw_schema(table)).withColumn(PERIOD, F.col(PERIOD).cast("date"))


def _silver_or_none_yet(spark: SparkSession, root: str, table: str) -> DataFrame:
    try:
        return read_table(spark, root, "silver", table)
    except FileNotFoundError:
        return silver.CLEANERS[table](spark.createDataFrame([], S.raw_schema(table)))


def refine_silver(spark: SparkSession, root: str, table: str, months: Sequence[date]) -> dict:
    landed = _raw_or_none_yet(spark, root, table)
    cleaned = silver.CLEANERS[table](of_months(landed, months))
    return _observed("silver", table, write_table(cleaned, path_of(root, "silver", table), months))


def state_path(root: str, mob: int = gold.MONTHS_ON_BOOK) -> str:
    return path_of(root, "silver", f"loan_months_{mob}")


def _published(spark: SparkSession, path: str) -> published.Manifest:
    return published.manifest(spark, path) or published.Manifest()


def _differing(loans: published.Manifest, state: published.Manifest) -> list[date]:
    """Months of silver loans that were landed again, or emptied, since the state was last brought up to them."""
    return sorted(date.fromisoformat(m) for m in {*loans.months, *state.sources} if loans.months.get(m) != state.sources.get(m))


def advance_state(spark: SparkSession, root: str, mob: int = gold.MONTHS_ON_BOOK) -> list[date]:
    """Bring the label state up to silver loans; returns the application months whose labels are out of date.

    Of silver loans only the months that changed are read. Application months stay on the state's list until
    ``settle`` takes them off, so a run that breaks off before gold is written leaves them to the next.
    """
    path, loans_path = state_path(root, mob), path_of(root, "silver", "loans")
    old, found = _published(spark, path), _published(spark, loans_path)
    stale = _differing(found, old)
    if not stale:
        return sorted(date.fromisoformat(m) for m in old.pending)
    landed = _silver_or_none_yet(spark, root, "loans") if not found.version else published.read(spark, loans_path, found.only(stale))
    sources = {m.isoformat(): found.months[m.isoformat()] for m in stale if m.isoformat() in found.months}
    load = published.stage(gold.loan_months(landed, mob), path)
    state = published.read(spark, path, load.onto(old, stale, sources))
    # The first rows of a state are all new.
    changed = None
    if old.months:
        before = published.read(spark, path, old.only(stale))
        state, changed = state.unionByName(before), of_months(state, stale).unionByName(before)
    touched = [r[0].isoformat() for r in gold.months_touched(state, changed, mob).collect()]
    published.publish(spark, load, stale, sources, touched)
    return sorted(date.fromisoformat(m) for m in {*old.pending, *touched})


def build_gold(
    spark: SparkSession, root: str, months: Sequence[date], mob: int = gold.MONTHS_ON_BOOK, dpd: int = gold.DAYS_PAST_DUE
) -> dict:
    """Label the loans that reach month ``mob`` in the given months, however late that is reported.

    Each is stored once under its application month. Rebuilt are the application months that ``months``
    own by the calendar and those in which a loan's rows were landed, changed or withdrawn since the last build.
    Reads the changed months of silver loans, the narrow label state and the features of the rebuilt months.
    """
    applied = sorted({*advance_state(spark, root, mob), *(shift_months(m, -mob) for m in months)})
    state = published.read(spark, state_path(root, mob))
    if state is None:
        state = gold.loan_months(_silver_or_none_yet(spark, root, "loans"), mob)
    features = [of_months(_silver_or_none_yet(spark, root, t), applied) for t in ("clickstream", "attributes", "financials")]
    held = _published(spark, state_path(root, mob)).months
    most = 2 * len(held.keys() & {m.isoformat() for m in applied}) >= len(held)
    built = gold.with_features(gold.labels_of_months(state, applied, mob, dpd, most), *features)
    metrics = write_table(built, path_of(root, "gold", "label_store"), applied)
    if published.manifest(spark, state_path(root, mob)) is not None:
        published.settle(spark, state_path(root, mob), applied)
    return _observed("gold", "label_store", metrics)


LOADS = (
    "run string, loaded_at timestamp, layer string, table string, rows bigint, without_customer bigint, "
    "first_month date, last_month date"
)


def load_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row per table and run: what was written, as the writing tasks observed it."""
    path = path_of(root, "metrics", "loads")
    try:
        return spark.read.schema(LOADS).json(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no loads at {path}: run a backfill first") from missing


def run_backfill(
    spark: SparkSession, raw: dict[str, DataFrame], root: str, months: Sequence[date],
    mob: int = gold.MONTHS_ON_BOOK, dpd: int = gold.DAYS_PAST_DUE,
) -> dict[str, int]:
    """Bronze, silver and gold for any set of months; returns rows per table.

    The sources do not wait for each other: each is landed and refined side by side with the rest. The metrics of
    all loads are kept, a file per run (``load_metrics``).
    """

    def landed_and_refined(table: str) -> list[dict]:
        return [land_bronze(raw[table], root, table, months), refine_silver(spark, root, table, months)]

    with no_shuffle_kept(spark):
        with ThreadPoolExecutor(len(S.TABLES)) as pool:
            loads = list(itertools.chain.from_iterable(pool.map(inheritable_thread_target(spark)(landed_and_refined), S.TABLES)))
        loads.append(build_gold(spark, root, months, mob, dpd))
    run = {"run": uuid.uuid4().hex, "loaded_at": datetime.now(UTC).isoformat()}
    lines = [json.dumps({**run, **load}, default=date.isoformat) for load in loads]
    published.put_text(spark, f"{path_of(root, 'metrics', 'loads')}/{run['run']}.json", "\n".join(lines))
    return {f"{load['layer']}.{load['table']}": load["rows"] for load in loads}


def append_months(parts: Sequence[DataFrame]) -> DataFrame:
    """Monthly parts of one table, matched by column name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
