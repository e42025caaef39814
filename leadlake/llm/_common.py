"""What the operators share: scratch tables, whole texts, distributed prefix sums."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the contracts: a word is a run of anything but the six ASCII white-space characters.
WORD_RX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; its own only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='leadlake-shared-')}"
    spark.sparkContext.setCheckpointDir(base)
    return base


_OPEN = threading.local()


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/leadlake-{name}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "scopes", None):
        _OPEN.scopes[-1].append(path)
    return path


def _reads(df: DataFrame) -> str:
    """The folders that df's plan reads."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out += [roots.apply(k).toString() for k in range(roots.size())]
    return "\n".join(out)


def tidy(f):
    """f, which returns a DataFrame, with its scratch tables removed at its end, except those that the result still reads."""

    @functools.wraps(f)
    def run(*args, **kw):
        if not hasattr(_OPEN, "scopes"):
            _OPEN.scopes = []
        _OPEN.scopes.append([])
        try:
            out = f(*args, **kw)
        finally:
            made = _OPEN.scopes.pop()
        needed, spark = _reads(out), out.sparkSession
        for path in made:
            if path.rpartition("/")[2] in needed:
                if _OPEN.scopes:
                    _OPEN.scopes[-1].append(path)
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return out

    return run


def cut(df: DataFrame, name: str = "cut", files: int | None = None, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and return its reader: the lineage ends here, a lost executor costs no recomputation, and its size is
    known to the planner. files: how many files suit its light rows (see tasks), so that small tables are not one file for each shuffle partition."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = (df.coalesce(files) if files else df).write
    for k, v in options.items():
        w = w.option(k, v)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs with all its columns in one struct `row`, so that no name of theirs clashes with the further columns."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in more.items()])


def free(docs: DataFrame, name: str) -> str:
    """name, or with as many underscores before it as make it no column of docs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def number() -> Column:
    """doc_id as a long."""
    return F.col("doc_id").cast("long")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def body(col: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RX)).cast("long")


def _runner(key: str | None, value: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        lean()
        part = TaskContext.get().partitionId()
        last, rank, total = object(), 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            if key:
                ks = b.column(key)
                codes = ks.dictionary_encode()
                idx = codes.indices.to_numpy(zero_copy_only=False)
                new = np.concatenate([[True], idx[1:] != idx[:-1]])
                names = codes.dictionary
                first, final = names[int(idx[0])].as_py(), names[int(idx[-1])].as_py()
            else:
                new = np.zeros(n, bool)
                new[0] = True
                first = final = None
            starts = np.flatnonzero(new)
            run_no = np.cumsum(new) - 1
            before = np.cumsum(v) - v
            base_sum, base_pos = before[starts], starts.astype(np.int64)
            local = before - base_sum[run_no]
            pos = np.arange(n, dtype=np.int64) - base_pos[run_no]
            if first == last:
                head = run_no == 0
                local[head] += total
                pos[head] += rank
            last, rank, total = final, int(pos[-1]) + 1, int(local[-1] + v[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(pos), pa.array(local)],
                names=[*b.schema.names, "_part", "_rank", "_before"],
            )

    return run


def prefix(df: DataFrame, order: list[str], value: str, key: str | None = None, name: str = "prefix") -> DataFrame:
    """Adds, over the rows of each key in the given order, _rank (rows before) and _before (sum of value before).

    The rows are dealt by range over (key, order), so a key with a third of all rows spreads over a third of the tasks. Each task
    sums its own run; one row for each (key, task) then gives the offsets. df must be light and cheap to read (it is sampled for the ranges);
    key and value hold no nulls.
    """
    by = ([key] if key else []) + order
    ranged = df.repartitionByRange(tasks(df), *by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType()), T.StructField("_before", T.LongType())])
    local = cut(ranged.mapInArrow(_runner(key, value), schema), f"{name}-local")
    k = [key] if key else []
    from pyspark.sql import Window as W

    totals = local.groupBy("_part", *k).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    w = W.partitionBy(*k).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", *k, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_s0"))
    totals = cut(totals, f"{name}-offsets", tasks(local))
    out = local.join(totals, ["_part", *k])
    return out.select(*df.columns, (F.col("_rank") + F.col("_n0")).alias("_rank"), (F.col("_before") + F.col("_s0")).alias("_before"))


#: The bitmap filter has 2**FILTER_BITS bits, 2 MB whatever the input: false positives cost shuffle, never results.
FILTER_BITS = 24


def bitmap(hashes: DataFrame, col: str) -> DataFrame:
    """A bitmap of the longs in col, folded to FILTER_BITS: at most 2**FILTER_BITS / 32768 rows of 1024 numbers of 32 bits."""
    p = hashes.select((F.pmod(F.col(col), F.lit(1 << FILTER_BITS)) + 1).alias("p"))
    bits = p.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    return bits.select("_bucket", F.expr("transform(sequence(0, 1023), i -> cast(conv(hex(substring(b, i * 4 + 1, 4)), 16, 10) as bigint))").alias("_bits"))


def maybe_in(rows: DataFrame, col: str, bits: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose col may be in the bitmap, or those whose col is not in it; the broadcast side is bounded by FILTER_BITS."""
    p = F.pmod(F.col(col), F.lit(1 << FILTER_BITS)) + 1
    probed = rows.withColumn("_bucket", F.bitmap_bucket_number(p)).withColumn("_at", F.bitmap_bit_position(p))
    # bytes stand in a number with the first one on top
    hit = F.expr("getbit(get(_bits, cast(_at div 32 as int)), cast((3 - _at % 32 div 8) * 8 + _at % 8 as int)) = 1")
    if inside:
        return probed.join(F.broadcast(bits), "_bucket").where(hit).drop("_bucket", "_at", "_bits")
    return probed.join(F.broadcast(bits), "_bucket", "left").where(~F.coalesce(hit, F.lit(False))).drop("_bucket", "_at", "_bits")


def lean(forget: bool = True) -> None:
    """Called as a task begins in a Python worker, which serves all operators in turn: what tokenizing keeps goes (unless the task needs it), free memory
    goes back to the system."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if forget and (tokens := sys.modules.get("leadlake.llm.tokens")) is not None:
        tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Light rows that one task writes, about: small tables are then a few files, not one for each shuffle partition.
LIGHT = 200_000


def tasks(table: DataFrame, per: int = LIGHT) -> int:
    """How many tasks suit the rows of a written table, parts() at most; the count is read from the files' footers."""
    return max(1, min(parts(table.sparkSession), -(-table.count() // per)))
