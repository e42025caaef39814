"""Embedding whitening by hierarchical merging of singular value decompositions.

Each task keeps, of the vectors it has read, their count, exact sums, and all singular values and right vectors of the centred rows. Two such states
merge by stacking their scaled right vectors, one row more that corrects for the difference of the means, and decomposing again. All dimensions are kept, so
nothing is lost, and the covariance is never multiplied out. Written states merge MERGE at a time, level by level, each group in a task of its
own. What is broadcast at last is one state: d sums, d values and d * d entries, whatever the number of rows.

Entries must be whole numbers, exact in 64 bits; sums are kept exactly. scaled() makes them from floats.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries go; so do those of other length than most vectors have (of equally
frequent lengths the longest counts); scaled entries are bounded to +-2**52; a null vec_id, repeated rows and ties are rows like others; an
empty table gives an empty result; further columns are not read. Directions without spread (relative to the widest, below rounding) can't be whitened:
their `whitened` is null, and they count neither in identity_error nor as lost in `explained`. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import cut

#: States that one task merges.
MERGE = 8

#: Entries of a block of vectors that is decomposed at once in a task.
BLOCK = 1 << 18

_STATE = "n long, sums array<decimal(38,0)>, values array<double>, vectors array<double>"


def scaled(vector: str, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each entry, as long."""
    one = lambda c: F.floor(F.greatest(F.lit(-(2.0**52)), F.least(F.lit(2.0**52), c.cast("double") * scale))) + F.lit(shift).cast("long")
    return F.transform(F.col(vector), one)


class State:
    """Count, exact sums, singular values and right singular vectors (as rows) of the centred rows seen."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        """Of a block of whole numbers."""
        n, low = len(x), x.min(axis=0)
        above = x - low  # exact, and small where entries lie close together
        sums = [int(s) + n * int(b) for s, b in zip(above.sum(axis=0, dtype=object if above.max(initial=0) > 2**62 // n else np.int64), low)]
        own = np.array([(s - n * int(b)) / n for s, b in zip(sums, low)])
        return cls(n, sums, *_svd(above - own))

    def merge(self, other: State) -> State:
        n = self.n + other.n
        # the difference of the means from exact sums
        step = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        correction = step * np.sqrt(self.n * (other.n / n))
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, correction])
        return State(n, [a + b for a, b in zip(self.sums, other.sums)], *_svd(rows))

    def row(self) -> dict:
        from decimal import Decimal

        return {"n": self.n, "sums": [Decimal(s) for s in self.sums], "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def read(cls, row) -> State:
        d = len(row["sums"])
        return cls(int(row["n"]), [int(s) for s in row["sums"]], np.array(row["values"], float), np.array(row["vectors"], float).reshape(-1, d))


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All d singular values (zeros where rows are fewer) and right vectors, each with its largest entry positive."""
    d = rows.shape[1]
    if len(rows) > 2 * d:
        rows = np.linalg.qr(rows, mode="r")  # the same values and right vectors, from d rows
    _, s, v = np.linalg.svd(rows, full_matrices=len(rows) < d)
    lead = np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1)
    return np.pad(s, (0, d - len(s))), v * np.where(lead < 0, -1.0, 1.0)


def _blocks(batches, name: str):
    """The batches' vectors, all of one length, as matrices of at most BLOCK entries, with the batch's rows they are."""
    for b in batches:
        col = b.column(name)
        if not b.num_rows:
            continue
        flat = col.flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(b.num_rows, -1)
        step = max(1, BLOCK // max(1, x.shape[1]))
        for at in range(0, len(x), step):
            yield b.slice(at, step), x[at : at + step]


def _states(batches):
    import pyarrow as pa

    total = None
    for _, x in _blocks(batches, "x"):
        s = State.of(x)
        total = s if total is None else total.merge(s)
    if total is not None:
        yield pa.RecordBatch.from_pylist([total.row()], schema=_arrow_state())


def _arrow_state():
    import pyarrow as pa

    return pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def _merged(table):
    import pyarrow as pa

    total = None
    for batch in table.to_batches():
        for row in batch.to_pylist():
            s = State.read(row)
            total = s if total is None else total.merge(s)
    return pa.Table.from_pylist([total.row()], schema=_arrow_state())


def _reduce(states: DataFrame, name: str) -> State | None:
    """The written states merged MERGE at a time, each group in one task, until one is left."""
    level = cut(states, f"{name}-states")
    count = level.count()
    while count > 1:
        groups = -(-count // MERGE)
        numbered = level.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("_g"))  # of written files, so the same at every try
        level = cut(numbered.groupBy("_g").applyInArrow(lambda t: _merged(t.drop_columns(["_g"])), _STATE), f"{name}-level")
        count = level.count()
    row = level.head()
    return State.read(row) if row else None


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null nor empty, of finite entries alone, of the most frequent length."""
    c = F.col(vector)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    good = df.where(c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True)))
    most = good.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return good.where(F.size(c) == (most["d"] if most else 0))


def fit(df: DataFrame, x: str = "x") -> State | None:
    """The state of all rows of df, whose column x holds arrays of longs of one length; None of no rows."""
    return _reduce(df.select(F.col(x).alias("x")).mapInArrow(_states, _STATE), "svd")


class Whitener:
    """Projects on the first `most` components, over the root of each one's variance; a few numbers for each dimension, so it travels in closures."""

    def __init__(self, state: State, most: int):
        d = len(state.sums)
        self.n, self.sums, self.k = state.n, state.sums, min(most, d)
        variance = state.values**2 / state.n
        self.low = np.array([s // state.n for s in state.sums], np.int64)
        self.rest = np.array([(s % state.n) / state.n for s in state.sums])
        spread = state.values[: self.k] > (state.values[0] * max(d, 1) * np.finfo(float).eps if d else 0)
        self.spread = spread
        root = np.sqrt(variance[: self.k])
        self.matrix = (state.vectors[: self.k] / np.where(spread, root, 1)[:, None]).T
        trace = variance.sum()
        self.explained = variance[: self.k] / trace if trace > 0 else np.zeros(self.k)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) - self.rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum over dimensions of (n * x - sums)**2, exactly; None beyond 64 bits."""
        gap = self.n * self.low.astype(object) - np.array(self.sums, object)
        near = x - self.low
        bound = (int(np.abs(near).max(initial=0)) * self.n + max((abs(int(g)) for g in gap), default=0)) ** 2 * len(self.low)
        kind = np.int64 if bound < 2**63 else object
        y = near.astype(kind) * self.n + gap.astype(kind)
        out = (y * y).sum(axis=1)
        return out.tolist() if kind is np.int64 else [int(v) if v < 2**63 else None for v in out]


def _covariances(model: Whitener):
    """A state (count, means, singular values and vectors) of the whitened rows of each task, for measuring how far their covariance is from the identity."""

    def run(batches):
        import pyarrow as pa

        n, mean, square = 0, np.zeros(model.k), np.zeros((model.k, model.k))
        for _, x in _blocks(batches, "x"):
            y = model.project(x)
            own = y.mean(axis=0)
            y = y - own  # centred before multiplying
            step, m = own - mean, len(y)
            square += y.T @ y + np.outer(step, step) * (n * m / (n + m))
            mean, n = mean + step * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "square": square.ravel().tolist()}])

    return run


def identity_error(df: DataFrame, model: Whitener) -> float | None:
    """The largest absolute entry of the whitened rows' covariance (divisor n) minus the identity, over the components with spread, measured on all rows."""
    parts = cut(df.select("x").mapInArrow(_covariances(model), "n long, mean array<double>, square array<double>"), "white-cov")
    # the tasks' means first, then their centred squares moved to the common mean: sums of k * k entries, by partial aggregation
    whole = parts.agg(F.sum("n").alias("total"))
    means = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    k = model.k
    entries = parts.select("n", "mean", F.posexplode("square").alias("at", "s"))
    entries = entries.select("n", "mean", "s", (F.expr(f"at div {k}")).cast("int").alias("i"), (F.col("at") % k).alias("j"))
    left, right = means.select("i", F.col("mean").alias("mi")), means.select(F.col("i").alias("j"), F.col("mean").alias("mj"))
    moved = entries.join(left, "i").join(right, "j")
    between = F.col("n") * (F.get("mean", F.col("i")) - F.col("mi")) * (F.get("mean", F.col("j")) - F.col("mj"))
    cov = moved.groupBy("i", "j").agg(F.sum(F.col("s") + between).alias("c")).crossJoin(F.broadcast(whole))
    live = [int(i) for i in np.flatnonzero(model.spread)]
    cov = cov.where(F.col("i").isin(live) & F.col("j").isin(live))
    row = cov.agg(F.max(F.abs(F.col("c") / F.col("total") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).head()
    return row[0]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """A row for each usable row: its key, x (scaled), deviation, and whitened, the coordinates on the first `most` components; with n, explained and identity_error."""
    rows = usable(df, vector).select(F.col(key).alias("key"), scaled(vector).alias("x"))
    id_type = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {id_type}, x array<long>, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    state = fit(rows)
    if state is None:
        return df.sparkSession.createDataFrame([], schema)
    model = Whitener(state, most)
    error = identity_error(rows, model)

    def run(batches):
        import pyarrow as pa

        for b, x in _blocks(batches, "x"):
            y = model.project(x)
            live = np.broadcast_to(model.spread, y.shape).ravel()
            white = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * model.k, pa.array(y.ravel(), mask=~live))
            shares = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * model.k, pa.array(np.tile(model.explained, len(y))))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("x"), pa.array(np.full(len(y), model.n)), pa.array(model.deviations(x), pa.int64()), white, shares, pa.array([error] * len(y), pa.float64())],
                names=[key, "x", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op12(embeddings: DataFrame) -> DataFrame:
    white = whiten(embeddings).select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return white.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
