"""Whitening of embedding vectors on an exact integer covariance.

Entries become whole numbers x = floor(64 c) + 1000000. Their cross-products are counted, not multiplied: every dimension is shifted to
start at 0, the bits of its values are packed across rows into 64-bit words (a bit slice per dimension and bit), and

    sum over rows of y_i * y_j  =  sum over bits a, b of 2^(a+b) * popcount(slice(i, a) AND slice(j, b)).

Each task adds up the counts of its rows and hands on one row per pair of dimensions, so what is shuffled and what reaches the driver
depends on the number of dimensions only. There the products are centred as whole numbers (n * sum(y_i y_j) - sum(y_i) sum(y_j), which
no shift changes) before the first division; the eigenvectors follow from ``numpy.linalg.eigh``.

Defined results: a row whose vector is null, holds a null, NaN or infinite entry, or has another length than most vectors (the longer of
equally frequent lengths) is left out of the fit and of the result. Entries beyond 2^55 in size count as 2^55. A component without variance
has null ``whitened`` values, and no part in the identity error; without any variance ``explained`` is null. An empty table, and vectors of
length 0, give no rows. Repeated rows and ids count as often as they stand there. ``deviation`` is
long (decimal(38,0) if the fit list holds one of over 18 digits) and null where that is too short; ``whitened_components`` has null where it is no 64-bit number.
Other columns are kept, unless they are named like an added one; the key may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tutorloom.llm.common import written

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**55  # of an entry, so that x stays below 2^62
BLOCK = 8192  # rows packed at once: their slices take a kilobyte for each dimension and bit
FLUSH = 1 << 20  # rows after which a task hands on its counts, so that weighted sums stay below 2^63
LIMB = 32  # bits of a product's weight that are summed in one number


@dataclass
class Whitening:
    """What the fit list tells: ``components`` are columns, largest eigenvalue first."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    reach: int  # no |n * x - S| is larger

    @property
    def width(self) -> int:
        return len(self.sums)

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the first ``k`` components; NaN for those that rounding alone can explain."""
        e = self.eigenvalues[:k]
        floor = max(float(self.eigenvalues.max(initial=0.0)), 0.0) * self.width * np.finfo(float).eps * 4
        return np.where(e > floor, 1 / np.sqrt(np.where(e > floor, e, 1)), np.nan)

    def explained(self, k: int) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues[:k]]


def usable(vector: Column) -> Column:
    """Whether all entries of the vector are there and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound, F.lit(False))


def vectors(df: DataFrame, vector: str) -> DataFrame:
    """The usable vectors of ``df`` alone, as column ``v``."""
    return df.select(F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))


def whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(entries, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, whole numbers) of the vectors of a batch, a matrix for each width."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        alike = column if (widths == width).all() else column.filter(pa.array(widths == width))
        if width:
            yield int(width), whole(alike.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, least, greatest and sum of every dimension over the rows of a task; sums as two numbers of 31 and 32 bits."""
    held: dict[int, list] = {}
    for batch in batches:
        for width, x in matrices(batch.column(0)):
            low, high, total = x.min(axis=0), x.max(axis=0), [(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
            if width in held:
                old = held[width]
                low, high, total = np.minimum(old[1], low), np.maximum(old[2], high), [old[3][0] + total[0], old[3][1] + total[1]]
            held[width] = [len(x) + (held[width][0] if width in held else 0), low, high, total]
    for width, (n, low, high, total) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(width, width)), pa.array(np.arange(width)), pa.array(np.full(width, n)), *map(pa.array, (low, high, *total))],
            ["width", "dim", "n", "low", "high", "upper", "lower"],
        )


def bit_slices(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of the non-negative columns of ``y`` packed across rows: a line of 64-bit words for each dimension and bit."""
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), dtype=np.int64)
    padded[: len(y)] = y
    lines = [np.packbits(((padded[:, d] >> b) & 1).astype(np.uint8)) for d, of in enumerate(bits) for b in range(of)]
    return np.stack(lines).view(np.uint64) if lines else np.zeros((0, 1), np.uint64)


def both_set(slices: np.ndarray) -> np.ndarray:
    """How many rows have both bits set, for each pair of slices."""
    out = np.zeros((len(slices), len(slices)), dtype=np.int64)
    for p in range(len(slices)):
        out[p, p:] = np.bitwise_count(slices[p:] & slices[p]).sum(axis=1, dtype=np.int64)
    return out + np.triu(out, 1).T


def weighted(counts: np.ndarray, bits: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(limb, dimension by dimension sums) of the counts under their weights 2^(a+b); limb l stands for a factor of 2^(32 l)."""
    moving = [d for d, of in enumerate(bits) if of]
    starts = np.cumsum([0, *(bits[d] for d in moving)])[:-1]
    place = np.concatenate([np.arange(bits[d]) for d in moving])
    weight = place[:, None] + place[None, :]
    for limb in range(int(weight.max()) // LIMB + 1):
        part = np.where(weight // LIMB == limb, counts << np.where(weight // LIMB == limb, weight % LIMB, 0), 0)
        sums = np.add.reduceat(np.add.reduceat(part, starts, axis=0), starts, axis=1)
        full = np.zeros((len(bits), len(bits)), dtype=np.int64)
        full[np.ix_(moving, moving)] = sums
        yield limb, full


def _products(low: list[int], bits: list[int]):
    """Sums of the products of shifted dimensions over the rows of a task."""
    width, shift = len(low), np.array(low, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, waiting, n_waiting = None, 0, [], 0

        def pack():
            nonlocal counts, rows, waiting, n_waiting
            x = np.concatenate(waiting)
            for at in range(0, len(x), BLOCK):
                found = both_set(bit_slices(x[at : at + BLOCK] - shift, bits))
                counts = found if counts is None else counts + found
            rows, waiting, n_waiting = rows + n_waiting, [], 0

        def sums():
            i, j = np.triu_indices(width)
            for limb, full in weighted(counts, bits):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(len(i), limb)), pa.array(full[i, j])], ["i", "j", "limb", "part"])

        for batch in batches:
            for w, x in matrices(batch.column(0)):
                if w == width:
                    waiting.append(x)
                    n_waiting += len(x)
            if n_waiting >= BLOCK:
                pack()
            if rows >= FLUSH:
                yield from sums()
                counts, rows = None, 0
        if n_waiting:
            pack()
        if rows:
            yield from sums()

    return run


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors of ``df``; None if there is none."""
    given = vectors(df, vector)
    ranges = given.mapInArrow(_ranges, "width long, dim long, n long, low long, high long, upper long, lower long")
    wide = F.lit(2**32).cast("decimal(38,0)")
    stats = written(
        ranges.groupBy("width", "dim").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
            (F.sum("upper").cast("decimal(27,0)") * wide).alias("upper"), F.sum("lower").alias("lower"),
        ),
        "ranges",
    )
    most = stats.agg(F.max(F.struct("n", "width")).alias("m")).first()["m"]
    if most is None:
        return None
    rows = stats.where(F.col("width") == most["width"]).orderBy("dim").collect()  # one for each dimension
    n, low = int(most["n"]), [int(r["low"]) for r in rows]
    sums = [int(r["upper"]) + int(r["lower"]) for r in rows]
    bits = [(int(r["high"]) - int(r["low"])).bit_length() for r in rows]
    width = len(low)
    total = [[0] * width for _ in range(width)]
    if any(bits):
        counted = given.mapInArrow(_products(low, bits), "i long, j long, limb long, part long")
        for r in counted.groupBy("i", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():  # a few for each pair of dimensions
            total[r["i"]][r["j"]] += int(r["part"]) << (LIMB * r["limb"])
    shifted = [s - n * a for s, a in zip(sums, low, strict=True)]
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            covariance[i, j] = covariance[j, i] = (n * total[i][j] - shifted[i] * shifted[j]) / (n * n)
    values, lines = np.linalg.eigh(covariance)
    values, lines = values[::-1], lines[:, ::-1]
    lines = lines * np.where(lines[np.abs(lines).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    reach = max(max(n * int(r["high"]) - s, s - n * int(r["low"])) for r, s in zip(rows, sums, strict=True))
    return Whitening(n, sums, values, lines, float(np.trace(covariance)), reach)


def _projected(model: Whitening, k: int, x: np.ndarray, digits: int = 38) -> tuple[np.ndarray, list | np.ndarray]:
    """Whitened values and deviations of the whole-number rows ``x``; deviations of over ``digits`` digits are None."""
    if model.n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        off = model.n * x - np.array(model.sums, dtype=np.int64)
        plain = model.width * int(np.abs(off).max(initial=0)) ** 2 < 10**18
    else:
        off, plain = model.n * x.astype(object) - np.array(model.sums, dtype=object), False
    deviation = (off * off).sum(axis=1) if plain else [d if d < 10**digits else None for d in (off.astype(object) ** 2).sum(axis=1).tolist()]
    centred = (off / model.n).astype(np.float64)
    return (centred @ model.components[:, :k]) * model.scales(k), deviation


def _plain(x: int | None) -> int | None:
    return None if x is None else int(x)


def _of_width(batch: pa.RecordBatch, vector: str, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    fits = pa.array(batch.column(vector).value_lengths().to_numpy(zero_copy_only=False) == width)
    kept = batch.filter(fits)
    return kept, whole(kept.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def transform(df: DataFrame, model: Whitening, k: int, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector with ``whitened`` (array of up to ``k`` values) and ``deviation``."""
    k = min(k, model.width)
    if vector in ("whitened", "deviation"):
        raise ValueError("the vectors may not be named like an added column")
    kept = df.drop("whitened", "deviation")
    names = kept.columns
    at = names.index(vector)
    given = kept.select([F.col(f"`{c}`").cast("array<double>").alias(c) if c == vector else F.col(f"`{c}`") for c in names]).where(usable(F.col(f"`{vector}`")))
    long = model.width * model.reach**2 < 10**18
    schema = S.StructType([*given.schema.fields, S.StructField("whitened", S.ArrayType(S.DoubleType())), S.StructField("deviation", S.LongType() if long else S.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = _of_width(batch, names[at], model.width)
            if not len(x):
                continue
            values, deviation = _projected(model, k, x, 18 if long else 38)
            flat = pa.array(values.reshape(-1), mask=np.isnan(values).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
            exact = pa.array(list(map(_plain, deviation)), pa.int64() if long else pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists, exact], [*names, "whitened", "deviation"])

    return given.mapInArrow(run, schema)


def identity_error(df: DataFrame, model: Whitening, k: int, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of the whitened values minus the identity, measured on all rows."""
    k = min(k, model.width)
    able = np.flatnonzero(~np.isnan(model.scales(k)))
    if not len(able):
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(len(able)), np.zeros((len(able), len(able)))
        for batch in batches:
            _, x = _of_width(batch, "v", model.width)
            z = _projected(model, k, x)[0][:, able]
            total, products = total + z.sum(axis=0), products + z.T @ z
        flat = np.concatenate([total, products.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "part"])

    parts = vectors(df, vector).mapInArrow(moments, "at long, part double").groupBy("at").agg(F.sum("part").alias("part"))
    flat = np.zeros(len(able) * (len(able) + 1))
    for r in parts.collect():  # one for each pair of components
        flat[r["at"]] = r["part"]
    mean = flat[: len(able)] / model.n
    covariance = flat[len(able) :].reshape(len(able), len(able)) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(able))).max())


def whitened_components(df: DataFrame, k: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable vector and component up to ``k``: key, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector)
    given = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    schema = S.StructType(
        [
            S.StructField(key, given.schema["id"].dataType), S.StructField("component", S.IntegerType()), S.StructField("n", S.LongType()), S.StructField("deviation", S.LongType()),
            S.StructField("whitened", S.DoubleType()), S.StructField("explained", S.DoubleType()), S.StructField("identity_error", S.DoubleType()),
        ]
    )
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    share = F.array(*[F.lit(x).cast("double") for x in model.explained(k)])
    error = identity_error(df, model, k, vector)
    rows = transform(given, model, k, "v").select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(key),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
