"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobacct.session import scratch_path

#: Word separators of the contracts that cut at white space: space, tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: Java pattern of what stands between words of letters and digits (beyond ASCII every character is a letter here).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as one table over UTF-8 bytes: A-Z to a-z, other ASCII beside 0-9 a-z to a space; bytes over 127 stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: Rows that a Python task turns into objects at a time.
SLICE = 256
#: A table is broadcast up to this many rows (checked by a count), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


class staging:
    """Tables that ``stage`` writes inside (by the same thread) are deleted at
    the end, but those marked ``out``: they belong to the scope around, if any."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> staging:
        _SCOPES.open.append([])
        return self

    def __exit__(self, *exc) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCOPES.open.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def stage(spark: SparkSession, df: DataFrame, name: str, out: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder of spark.checkpoint.dir and read it
    back: the lineage is cut and lost executors lose nothing. Inside a
    ``staging`` scope the table goes at its end, unless it is ``out``."""
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    if len(_SCOPES.open) > out:
        _SCOPES.open[-1 - out].append(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a count proves that ``df`` (staged or small to count) has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it ``fits``; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, most) else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def byte_words(text: str | None) -> list[bytes]:
    """``words_of`` inside a task, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def fold_1_of_3(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 = 1: held out. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_texts(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, n: int, *cols: str) -> list[tuple]:
    """(text, ``cols`` of ``ids``) of at most ``n`` documents: those of ``ids``
    (column _l) with the least hash, one row an id, copies once. The ids are
    chosen first and broadcast (n rows at most), so no text is shuffled but theirs."""
    some = F.broadcast(ids.orderBy(F.xxhash64("_l"), "_l").limit(n))
    d = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    rows = d.join(some, F.col("_id") == F.col("_l")).groupBy("_id").agg(F.min("_t").alias("_t"), *(F.max(c).alias(c) for c in cols))
    return list(dict.fromkeys(tuple(r) for r in rows.orderBy(F.xxhash64("_id"), "_id").select("_t", *cols).collect()))


def map_batches(
    docs: DataFrame,
    text: str | Sequence[str | Column],
    make: Callable[[], Callable[..., tuple]],
    schema: T.StructType,
    keep: list[str] | None = None,
    many: bool = False,
) -> DataFrame:
    """One result row per row: the ``keep`` columns, then those of ``schema``.

    ``make()`` runs once a task and gives the function from a text (or the
    values of several columns) to the values of ``schema``. Rows stream through
    Arrow in slices of ``SLICE``, so a task holds few texts at a time. ``keep``
    defaults to all columns that the results do not replace; whatever their
    names, they cannot clash with the inputs. With ``many`` the function takes a
    slice of values of each column at once and gives their rows."""
    new = {f.name.lower() for f in schema}
    keep = [c for c in docs.columns if c.lower() not in new] if keep is None else keep
    inputs = [text] if isinstance(text, str) else list(text)
    out = T.StructType([docs.schema[c] for c in keep] + list(schema))
    arrow = to_arrow_schema(T.StructType(list(schema)))
    kept = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)]
    src = docs.select(*kept, *((F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"input{i}") for i, c in enumerate(inputs)))
    first, last = len(keep), len(keep) + len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = [part.column(i).to_pylist() for i in range(first, last)]
                rows = f(*values) if many else list(map(f, *values))
                cols = list(zip(*rows, strict=True))
                made = [pa.array(c, field.type) for c, field in zip(cols, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:first], *made], names=[*keep, *arrow.names])

    return src.mapInArrow(run, out)
