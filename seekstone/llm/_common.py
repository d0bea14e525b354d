"""What the corpus operators share: columns by exact name, written tables, batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and \t \n \v \f \r (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names = df.columns
    return df.toDF(*[f"__c{i}" for i in range(len(names))]), names


def _exact(names: list[str], name: str):
    return F.col(f"__c{names.index(name)}") if name in names else F.lit(None)


def pick(df: DataFrame, *specs: str) -> DataFrame:
    """Only the columns "name type", matched by exact case; a missing one is null.

    Columns are renamed by position first, so extra columns whose names clash
    with each other (``TEXT`` beside ``text``) or with internal ones do no harm.
    """
    flat, names = _positional(df)
    pairs = [s.split(" ", 1) for s in specs]
    return flat.select(*[_exact(names, n).cast(t).alias(n) for n, t in pairs])


def only(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched by exact case, with their own types."""
    flat, own = _positional(df)
    return flat.select(*[_exact(own, n).alias(n) for n in names])


def pack(df: DataFrame, *specs: str) -> tuple[DataFrame, list[str]]:
    """As :func:`pick`, with the whole original row beside it in the struct ``__row``."""
    flat, names = _positional(df)
    pairs = [s.split(" ", 1) for s in specs]
    row = F.struct(*[F.col(f"__c{i}") for i in range(len(names))]).alias(ROW)
    return flat.select(row, *[_exact(names, n).cast(t).alias(n) for n, t in pairs]), names


def unpack(df: DataFrame, names: list[str], **changed) -> DataFrame:
    """The original columns of a packed frame, those in ``changed`` replaced."""
    cols = [changed.get(n, F.col(f"{ROW}.__c{i}")).alias(f"__c{i}") for i, n in enumerate(names)]
    return df.select(*cols).toDF(*names)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas compute what they close over each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: spark.checkpoint.dir, or the context's checkpoint folder; a
    temporary folder of our own only where there is neither and all runs on one machine (as in
    tests). A cluster without such a folder is an error."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_seekstone_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="seekstone-")
        sc._seekstone_dir = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the application's folder goes at exit."""
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/seekstone-{sc.applicationId}"
    if not getattr(sc, "_seekstone_atexit", False):
        sc._seekstone_atexit = True
        atexit.register(_remove, sc, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(sc, path: str) -> None:
    if sc._jsc is None:
        return
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. Survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def all_of(frames: list[DataFrame]) -> DataFrame:
    """The union of frames of one schema that :func:`written` returned, as one scan."""
    paths = [f.written_path for f in frames]
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*paths)


def frequent(keyed: DataFrame, n: str, *keys: str, most: int, least: int = 2) -> DataFrame:
    """The ``most`` rows of greatest ``n`` (``least`` at least); written. A key that isn't among them has fewer than a
    ``most``-th of all rows, so it may be dealt by its hash, whatever its number."""
    return written(keyed.where(F.col(n) >= least).orderBy(F.desc(n), *keys).limit(most), "frequent")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts don't pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def slices(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts have ``limit`` characters together, or one text each."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
