"""Helpers that the text operators share: tables, cut points and byte-level batches."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word definition here: space, tab, newline, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
#: Text bytes that one numpy step holds at a time, unless one text alone is longer.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


#: What tells rows apart where ids may repeat: the id and 128 bits of the text.
KEY = ["id", "s1", "s2"]


def signed(id_column: Column, docs: DataFrame, text_column: str = "text", *more: Column) -> DataFrame:
    """KEY, text (null as empty) and more columns of docs. s1 and s2 are two hashes of the text with seeds of their own."""
    text = whole(text_column)
    return docs.select(id_column.alias("id"), F.xxhash64(text).alias("s1"), F.xxhash64(F.lit("second"), text).alias("s2"), text.alias("text"), *more)


def held_out(column: str = "doc_id") -> Column:
    """True for rows kept from training: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="refloom-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A temporary one only where none is named and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_folder()
    return folder


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The result has no lineage, so a lost executor costs no more than the reads of it. The files stay until the folder goes, or until the temporary() or tidied() block ends in
    which they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What cut() writes inside the block is deleted at its end, but for what the block's function is given and writes. Each thread has its own."""
    before, written, kept = _written.get(), [], set()
    token = _written.set(written)

    def keep(df: DataFrame) -> DataFrame:
        out = cut(df)
        kept.add(written[-1])
        return out

    try:
        yield keep
    finally:
        _written.reset(token)
        _delete(spark, [p for p in written if p not in kept])
        if before is not None:
            before.extend(kept)


def tidied(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage (first argument: the session) that deletes what it has written on its way, but for the tables that its result reads."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        before, written = _written.get(), []
        token = _written.set(written)
        try:
            result = query(spark, *args)
            read = {f.rsplit("/", 2)[-2] for f in result.inputFiles()}
            kept = [p for p in written if p.rsplit("/", 1)[-1] in read]
            _delete(spark, [p for p in written if p not in kept])
        finally:
            _written.reset(token)
        if before is not None:
            before.extend(kept)
        return result

    return run


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", hot: int = 20_000) -> DataFrame:
    """rows joined with facts, which has one row for each key, so that no task holds a hot key's rows.

    weight: the column of facts that counts a key's rows; total: their sum. A key with at least one in `hot` of all rows is hot. There can be `hot` of
    them at most, whatever the size of the table, so these are broadcast; any other key has too few rows to matter to the task that gets it.
    how: inner or left. The weight is left out of the result.
    """
    is_hot = F.col(weight) * F.lit(hot) >= F.lit(total)
    few, rest = F.broadcast(facts.where(is_hot).drop(weight)), facts.where(~is_hot).drop(weight)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(rest, on, how))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `number`, their place (1, 2, 3 ...) in a total order of all rows, without a window over the table.

    Rows are dealt to ranges and sorted in each; a row's number is its place in its range plus the sizes of those before, of which the driver sees one
    number a range. The ranges are written first, so a lost executor can't deal them anew. An order with ties numbers equal rows as they come.
    """
    place = F.monotonically_increasing_id()  # the range above 33 bits, the place in it below
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    dealt = dealt.withColumn("_range", F.shiftright("_place", 33).cast("int"))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = dict(zip((k for k, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    offset = F.element_at(F.map_from_arrays(F.lit(list(before)), F.lit(list(before.values()))), F.col("_range")) if before else F.lit(0)
    return dealt.withColumn("number", (offset + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_place", "_range")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches hold whole texts, so fewer rows each bound the memory of executors and their Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches so that each part has about `limit` bytes of text at most.

    Yields (rows, bounds, data): the UTF-8 bytes of row i are data[bounds[i]:bounds[i + 1]]; null is empty.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
            part = bounds[first : last + 1]
            yield batch.slice(first, last - first), part - part[0], data[part[0] : part[-1]]
            first = last


def texts_of(bounds: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits (multiply and shift, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of `width` values: equal runs have equal hashes wherever they stand. Works in place: of a long text there are three arrays at a time."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = powers(base, len(values) - 1)
    sums *= values.astype(np.uint64, copy=False) if values.dtype.kind != "u" else values
    np.cumsum(sums, out=sums)
    out = sums[width - 1 :].copy()
    out[1:] -= sums[: n - 1]
    del sums
    out *= powers(pow(base, -1, 1 << 64), n - 1)  # base is odd, so it has an inverse
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # as mixed() does
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(31)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` values, the position of its lowest value (the leftmost of equals)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    # a window's minimum is that of two overlapping runs whose length is a power of two
    best, run = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), 1
    while run * 2 <= width:
        left, right = best[: len(best) - run], best[run:]
        best = np.where(values[right] < values[left], right, left)
        run *= 2
    left, right = best[: n - width + 1], best[width - run : n - run + 1]
    return np.where(values[right] < values[left], right, left)


def changes(values: np.ndarray) -> np.ndarray:
    """Positions at which a value differs from the one before; the first one counts."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def bounded_sample(rows: DataFrame, by: str, per_class: int, id_column: str = "doc_id", max_classes: int = 2000, total_bytes: int | None = None) -> DataFrame:
    """per_class rows at most of each class of `by`, chosen by a hash of the id: the same ones in every run.

    A class keeps each row with a chance of twice its share before the rows are ranked, so a huge class is thinned before any shuffle.
    With total_bytes, a class keeps the first of its rows whose texts fit into its part of that, one at least. Adds class_size, the class's row count. Rows with a null class or id are left out. More than max_classes classes, which bound the driver's
    list of them, are an error: none is left out silently.
    """
    rows = rows.where(F.col(by).isNotNull() & F.col(id_column).isNotNull())
    sizes = rows.groupBy(by).agg(F.count("*").alias("n")).limit(max_classes + 1).collect()
    if len(sizes) > max_classes:
        raise ValueError(f"{by} has more than {max_classes} classes")
    if not sizes:
        return rows.withColumn("class_size", F.lit(0).cast("long")).where("false")
    known = F.map_from_arrays(F.lit([r[by] for r in sizes]), F.lit([r.n for r in sizes]))
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    thinned = rows.withColumn("class_size", F.try_element_at(known, F.col(by)).cast("long")).where(draw * F.col("class_size") < 2 * per_class + 16)
    order = Window.partitionBy(by).orderBy(draw, F.col(id_column), "text")
    ranked = thinned.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class)
    if total_bytes is not None:
        held = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        ranked = ranked.withColumn("_held", held).where((F.col("_rank") == 1) | (F.col("_held") <= total_bytes // len(sizes))).drop("_held")
    return ranked.drop("_rank")
