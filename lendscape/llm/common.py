"""What several operators of this package need: inputs, running totals, writing and reading files."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import lendscape

# Words are runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Words of 64 bits in the filter that says which keys may be in a table: 4 MB when all are used.
FILTER_WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package along with the session's jobs, once: workers need not have it installed.

    Spark's file server hands the archive to every executor.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = Path(lendscape.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="lendscape-")) / "lendscape_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(application)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Prepare for Python workers: they get the package, and ``rows`` rows per Arrow batch.

    Texts are of any length, so a batch of thousands could fill a worker.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Narrow batches put together to about ``rows`` rows each, for work that costs by the batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A 52-bit whole number drawn from MD5 of the parts, equal on every engine."""
    named = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *named)), 1, 13), 16, 10).cast("long")


def running_total(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Exclusive running total of ``amount`` in each group, along ``bucket`` and then ``order``.

    Two levels, so that no group has to be sorted in one task: rows are summed inside a
    (group, bucket) cell, cells are put behind each other by their totals. ``bucket`` has to grow
    with ``order``. The columns of ``by`` and ``bucket`` must not be null.
    """
    held = df.withColumn("_amount", amount)
    cell = [*by, bucket]
    cells = held.groupBy(*cell).agg(F.sum("_amount").alias("_total"))
    along = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = cells.select(*cell, (F.sum("_total").over(along) - F.col("_total")).alias("_before"))
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.withColumn("_inside", F.sum("_amount").over(inside) - F.col("_amount"))
    total = (F.col("_before") + F.col("_inside")).alias(name)
    return placed.join(before, on=cell).select(*df.columns, total)


def perhaps_in(df: DataFrame, held: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: false only where ``key`` is not among those of ``held``. Neither side is shuffled.

    A row of ``held`` sets one bit of FILTER_WORDS 64-bit words, chosen by a hash; the words that have bits are broadcast,
    so what is broadcast is bounded and the more keys there are, the more rows just pass. A null key is not among them.
    """
    place = F.xxhash64(key)
    at, bit = F.pmod(place, F.lit(FILTER_WORDS)), F.pmod(F.shiftrightunsigned(place, 32), F.lit(64)).cast("int")
    word, bits = fresh(df, "_word"), fresh(df, "_bits")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = held.filter(F.col(key).isNotNull()).groupBy(at.alias(word)).agg(F.bit_or(one).alias(bits))
    marked = df.withColumn(word, at).join(F.broadcast(words), word, "left")
    return marked.withColumn(name, F.col(key).isNotNull() & (F.getbit(F.coalesce(bits, F.lit(0)), bit) == 1)).drop(word, bits)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there. Paths without a scheme are shared mounts."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_file(path: str, data: bytes) -> None:
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as source:
        return source.read()


def read_range(path: str, offset: int, length: int) -> bytes:
    fs, at = filesystem(path)
    with fs.open_input_file(at) as source:
        return source.read_at(length, offset)
