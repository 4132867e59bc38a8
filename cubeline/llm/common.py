"""What the operators of this folder share: the shared folder, staging, and ordered neighbours."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, wherever the session was started from.

    On a cluster the package is installed or sent along (--py-files) as any other; an extra path does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (root, env.get("PYTHONPATH"))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only a local master (tests) may
    leave that unset; a folder of this machine is then right, as there is no other machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    shared_dir(spark)  # sets a checkpoint folder where tests have none
    return f"{shared_dir(spark)}/cubeline/{name}-{uuid.uuid4().hex}"


def few_files(df: DataFrame) -> DataFrame:
    """Rows of a few bytes, dealt to a quarter of the session's shuffle partitions: a file each would be tiny."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and survives lost executors.

    `narrow`: rows are a few bytes, and go to few files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (few_files(df) if narrow else df).write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(staged: DataFrame) -> None:
    """Delete what stage() wrote, once nothing that is still to run needs it."""
    p = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    p.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has them (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def whole_text(name: str = "text") -> Column:
    """A text, null counted as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Stored bytes of a range, and of a scan's partition at least, about.
RANGE_BYTES, PART_BYTES = 32 << 20, 16 << 20


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the files behind a table, as the optimiser knows them; None where it doesn't."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def joined_parts(docs: DataFrame, least: int = 12) -> DataFrame:
    """A scan whose partitions are small has them put together, without a shuffle: a task, a worker and a file for each would cost more than its rows.

    Partitions of the usual size stay as they are.
    """
    size = stored_bytes(docs)
    return docs if size is None else docs.coalesce(max(least, -(-size // PART_BYTES)))


def ranges_for(df: DataFrame, least: int = 12) -> int:
    """How many ranges a table is dealt to, by the bytes its files have; where those aren't known, as many as shuffles have partitions."""
    size = stored_bytes(df)
    return max(least, -(-size // RANGE_BYTES) if size is not None else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Keys sampled for each bucket when boundaries are set, and in all.  They bound what the driver sees, not the rows processed.
SAMPLE_PER_BUCKET, SAMPLE_MOST = 40, 1_000_000


def ordered_buckets(df: DataFrame, key: Column, buckets: int, *, before: bool, after: bool, wrap: bool = False, mark: Column | None = None) -> DataFrame:
    """Deal df into `buckets` ranges of a string key, each with its neighbours at the edges.

    Every row comes out once with side 0.  The rows that hold a bucket's lowest key come out
    again with side 1 in the bucket before it (`after`), those with its highest key with side
    -1 in the bucket after it (`before`); with `wrap` the first bucket follows the last.  With
    `mark`, a value that follows from the key, and where rows of one mark lie on both sides of
    an edge, the nearest rows of another mark come along, from beyond whole buckets if need be.
    Columns `_key`, `_bucket` and `_side` are added; a partition holds whole buckets, sorted
    by (_bucket, _side, _key).  Texts are shuffled once.  The driver gets a bounded sample of
    keys and two keys a bucket (four with `mark`), never rows.
    """
    keyed = df.withColumn("_key", F.translate(key, _BETWEEN, ""))
    keys = keyed.select("_key") if mark is None else keyed.select("_key", mark.alias("_mark"))
    # the keys whose hash is under a threshold: about as many as asked for, the same in every run
    share = min(1.0, min(SAMPLE_PER_BUCKET * buckets, SAMPLE_MOST) / max(1, df.count()))
    drawn = keys.select("_key").where(F.xxhash64("_key") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).collect()
    seen = sorted(r[0] for r in drawn)
    cuts = sorted({seen[i * len(seen) // buckets] for i in range(1, buckets)}) if seen else []
    own = _bucket_of(F.col("_key"), cuts)
    dealt = keys.withColumn("b", own)
    marks = [] if mark is None else [F.min_by("_mark", "_key"), F.max_by("_mark", "_key")]
    ends = {r[0]: tuple(r[1:]) for r in dealt.groupBy("b").agg(F.min("_key"), F.max("_key"), *marks).collect()}
    full = sorted(ends)
    more: dict[str, list[int]] = {}  # of a key: the buckets it comes to besides its own, with the side
    for at, b in enumerate(full):
        prev = full[at - 1] if at else (full[-1] if wrap else None)
        if after and prev is not None:
            more.setdefault(ends[b][0], []).append(prev * 4 + 1)
        nxt = full[at + 1] if at + 1 < len(full) else None
        if before and nxt is not None:
            more.setdefault(ends[b][1], []).append(nxt * 4 + 3)
    if mark is not None:
        for k, b, side in _unlike(dealt, ends):
            if after if side == 1 else before:
                more.setdefault(k, []).append(b * 4 + side % 4)
    edges = df.sparkSession.createDataFrame(sorted(more.items()), "_key string, _also array<int>")  # four rows a bucket at most
    code = F.col("_to")
    return (
        keyed.join(F.broadcast(edges), "_key", "left")
        .withColumn("_to", F.explode(F.concat(F.array(own * 4), F.coalesce("_also", F.array().cast("array<int>")))))
        .withColumn("_bucket", F.floor(code / 4).cast("int"))
        .withColumn("_side", F.when(code % 4 == 3, -1).otherwise(code % 4).cast("int"))
        .drop("_to", "_also")
        .repartitionById(buckets, F.col("_bucket"))
        .sortWithinPartitions("_bucket", "_side", "_key")
    )


#: Stands between the boundary keys of a plan; keys are without it.
_BETWEEN = "\x02"


def _bucket_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted cuts are not above the key: a binary search over one literal array."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(_BETWEEN.join(cuts)), _BETWEEN, -1)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get(table, n + half - 1) <= key, n + half).otherwise(n))


def _unlike(keys: DataFrame, ends: dict[int, tuple[str, str, str, str]]) -> list[tuple[str, int, int]]:
    """(key, bucket it comes to, side) of the rows nearest to an edge that are of another mark than those on both sides of it.

    keys: _key, _mark, b; ends: lowest and highest key of each bucket and their marks.
    """
    full = sorted(ends)
    joins = [(a, b) for a, b in zip(full, full[1:], strict=False) if ends[a][3] == ends[b][2]]
    if not joins:
        return []
    low, high = {b: ends[b][2] for _, b in joins}, {a: ends[a][3] for a, _ in joins}
    edges = keys.sparkSession.createDataFrame([(b, low.get(b), high.get(b)) for b in sorted(low | high)], "b int, _low string, _high string")  # a row a bucket
    inner = lambda m: F.when(F.col(m) != F.col("_mark"), F.col("_key"))
    found = keys.join(F.broadcast(edges), "b").groupBy("b").agg(F.min(inner("_low")), F.max(inner("_high"))).collect()
    seconds = {r[0]: (r[1], r[2]) for r in found}
    out = []
    for side, order, first, last in ((-1, full, 2, 3), (1, full[::-1], 3, 2)):
        at = other = None  # the last (key, mark) met, and the last of another mark
        for b in order:
            if at is not None and at[1] == ends[b][first] and other is not None:
                out.append((other[0], b, side))
            now = (ends[b][last - 2], ends[b][last])
            second = seconds.get(b, (None, None))[1 if side == -1 else 0]
            if second is not None:
                other = (second, None)
            elif at is not None and at[1] != now[1]:
                other = at
            at = now
    return out


def long_key(c: Column) -> Column:
    """A string that sorts as a long does, null first."""
    shifted = c.cast("decimal(20,0)") + F.expr(f"{2**63}BD")
    return F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit(""))
