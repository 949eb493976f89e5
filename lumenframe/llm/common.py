"""What the operators share: tables in the shared folder, bounded samples, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.spread import spread

#: Characters that separate words: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one long that are broadcast at most.
MOST_BROADCAST = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or the
    checkpoint folder that is set.

    Only on a single machine (a local master) a temporary folder is made where neither is
    given; on a cluster that is an error, since executors don't share their disks.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenframe-"))
        given = sc.getCheckpointDir()
    return given.rstrip("/")


#: Folders that this process has written, oldest first.
_written: list[str] = []


def written() -> int:
    """A mark for ``sweep``: how many tables there are so far."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Removes the tables written after the mark ``since``, but for those to keep.  Frames
    that still read them can't be evaluated again."""
    for path in [p for p in _written[since:] if p not in keep]:
        _remove(spark, path)
        _written.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return a scan of it.

    This cuts lineage: a lost executor costs the tasks it held, not the table.  A table that
    isn't discarded before is removed when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _files(spark, path, lambda fs, at: fs.deleteOnExit(at))
    df.write.option("compression", "zstd").parquet(path)  # no direct buffers, unlike the default
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _written.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote."""
    _remove(df.sparkSession, df.written_to)
    _written.remove(df.written_to)


def _files(spark: SparkSession, path: str, ask: Callable) -> object:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return ask(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def _remove(spark: SparkSession, path: str) -> None:
    _files(spark, path, lambda fs, at: fs.delete(at, True))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at most a batch, so that what is made of a batch of long
    texts stays small however many rows Spark hands over at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def in_arrow(df: DataFrame, run: Callable, schema: StructType | str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over small slices, dealt out to idle cores if a plain scan leaves any."""
    return spread(df).mapInArrow(lambda batches: run(slices(batches, rows)), schema)


def numbered_rows(docs: DataFrame, id_col: str, text_col: str, run: Callable, added: str) -> DataFrame:
    """(row, id, n, digest and the columns ``added``) of each row: the row as a struct, its
    id, a number and a digest of its content.  ``run`` gets batches of row, id and text and
    appends its columns.  To be written before use: numbers change when computed again."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(added).fields])
    out = in_arrow(rows, run, schema).drop("text")
    return out.withColumn("digest", F.xxhash64("row")).withColumn("n", F.monotonically_increasing_id())


def one_of_each_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of ``numbered_rows`` (column ``fp``) that stay when each part keeps one: that of
    the smallest id, rows without one last, rows that share it by a digest of their content.
    ``parts``: (node, part) of linked fingerprints; any other is a part of its own.

    The rows themselves aren't shuffled while the numbers of those that go can be broadcast."""
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "digest", "n")
    least = rows.groupBy("fp").agg(F.min(order).alias("first"))
    of = least.join(parts, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("part", "fp").alias("part"))
    kept = materialise(of.agg(F.min("first").alias("first")).select("first.n"), "kept_numbers")
    gone = materialise(rows.select("n").join(kept, "n", "left_anti"), "dropped_numbers")
    discard(kept)
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return rows.join(gone, "n", "left_anti").select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` of the distinct rows, chosen by a hash of the whole row.

    For fitting classifiers on labelled rows only.  All distinct rows if there are fewer; equal
    rows count once, so neither copies nor a key with many rows pass the bound."""
    df = df.distinct()
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(*df.columns, F.lit("sample")), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def bounded_texts(df: DataFrame, bound: int, text_col: str = "text") -> DataFrame:
    """``bounded_sample`` for rows with a whole text: copies are told by a hash, and only the
    sample's own texts are shuffled, one of a partition's copies each."""
    others = [c for c in df.columns if c != text_col]
    keyed = df.withColumn("h", F.xxhash64(*df.columns))
    n = keyed.select("h").distinct().count()
    if n > bound:
        keyed = keyed.where(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 30)) < int(bound / n * (1 << 30)))
    return keyed.groupBy("h", *others).agg(F.first(text_col).alias(text_col)).select(*df.columns)


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, part) of every node in ``links`` (a, b); part is the smallest node reachable.

    Alternates large-star and small-star rounds (edges only move towards the smallest
    neighbour; the number of rounds grows with the logarithm of the size).  Each round is
    two aggregations and two joins over the edges; the minima are combined before they
    are shuffled, and nothing but two counters reaches the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialise(small, "small_star")
        now = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        discard(edges)
        discard(large)
        edges = small
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("part"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(roots)
