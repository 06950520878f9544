"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers x = floor(64 * c) + 1000000, so that sums and deviations are exact.
Rows are centred and reduced to one triangle R by QR: each task folds its rows block by block,
triangles are folded by groups of ``FAN`` tasks in rounds, and the driver gets few triangles of the
vectors' dimension, whatever the number of rows. R is brought to an upper bidiagonal B by
Householder reflections; differential qd with shifts (dqds) finds the singular values of B to high
relative accuracy, largest to smallest, without forming a covariance; twisted factorisations of
B'B give each direction, joined where it is best determined. Among close singular values the
twists whose directions lie beside the ones found before are taken, and made orthogonal.

A direction's variance is e = s**2 / n. Rows are whitened by one product per batch. How far the
whitened rows' covariance is from the identity is measured on the rows, not derived.

Defined results: a row is left out if its vector is null, empty, of another length than most (ties:
the longer), holds a null, a nan or an infinite entry, or one beyond 2**56 in size; a deviation
beyond a long is null; a direction without variance (below ``FLAT`` of the largest) is a component
whose ``whitened`` is null and that does not count in ``identity_error``; with one row, or equal
rows, all are, ``explained`` is null and ``identity_error`` is 0; repeated rows count as often as
they occur; an empty table gives no rows; other columns never matter. A component's largest entry
is positive.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from runlens.llm.text import lean
from runlens.sources.store import settle

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0**62
BLOCK = 1024  # rows folded at once
FAN = 64
FLAT = 1e-13  # share of the largest variance below which a direction has none
EPS = np.finfo(float).eps
OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


# --- rows of a batch ---------------------------------------------------------------------------


def _grouped(batch):
    """(length, row numbers, entries as doubles) of the rows of each length, all entries finite."""
    column = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == length)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), length)
        with np.errstate(over="ignore"):
            scaled = np.floor(values * SCALE)
        fine = (np.isfinite(values) & (np.abs(scaled) < LIMIT)).all(axis=1)
        # Without the shift, which drops out of all that is centred.
        yield int(length), rows[fine], scaled[fine].astype(np.int64)


def _selected(vectors, vec_id, vector):
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))


def _exact_sums(whole):
    """Column sums of whole numbers as Python integers."""
    if not len(whole):
        return [0] * whole.shape[1]
    if float(np.abs(whole).max()) * len(whole) < 2.0**62:
        return whole.sum(axis=0).tolist()
    return [sum(column.tolist()) for column in whole.T]


def _counts(rows):
    """(length, position, total, n) of all rows, as a stored table."""

    def run(batches):
        sums, n = {}, {}
        for batch in batches:
            for length, kept, whole in _grouped(batch):
                n[length] = n.get(length, 0) + len(kept)
                old = sums.get(length, [0] * length)
                sums[length] = [a + b for a, b in zip(old, _exact_sums(whole))]
        for length, totals in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "length": pa.array([length] * length, pa.int32()),
                    "position": pa.array(range(length), pa.int32()),
                    "total": pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0)),
                    "n": pa.array([n[length]] * length, pa.int64()),
                }
            )

    schema = "length int, position int, total decimal(38,0), n long"
    parts = rows.mapInArrow(lean(run), schema)
    return settle(
        parts.groupBy("length", "position").agg(
            F.sum("total").cast("string").alias("total"), F.sum("n").alias("n")
        ),
        "sums",
    )


def _centred(whole, n, sums):
    """n * x - S: as 64-bit numbers if all of them surely fit, else as Python integers."""
    bound = n * float(np.abs(whole).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 2.0**62:
        return whole * np.int64(n) - np.array(sums, dtype=np.int64)
    return whole.astype(object) * n - np.array(sums, dtype=object)


def _deviations(centred):
    """Exact sums of squares; None beyond a long."""
    if centred.dtype != object:
        if float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2.0**62:
            return (centred * centred).sum(axis=1).tolist()
    found = (sum(v * v for v in row) for row in centred.tolist())
    return [d if d < 2**63 else None for d in found]


class Fit:
    """What the rows are centred by: their length, number and column sums."""

    def __init__(self, length, n, sums):
        self.length, self.n, self.sums = length, n, sums

    def rows(self, batch):
        """(row numbers, n * x - S) of the batch's fitting rows."""
        for length, kept, whole in _grouped(batch):
            if length == self.length:
                for low in range(0, len(kept), BLOCK):
                    some = whole[low : low + BLOCK]
                    yield kept[low : low + BLOCK], _centred(some, self.n, self.sums)

    def doubles(self, centred):
        return centred.astype(np.float64) / self.n


def _fit(rows):
    stored = _counts(rows)
    top = stored.where("position = 0 and n > 0").orderBy(F.desc("n"), F.desc("length")).first()
    if top is None:
        return None
    sums = stored.where(F.col("length") == top["length"]).orderBy("position").collect()
    return Fit(top["length"], top["n"], [int(r["total"]) for r in sums])


# --- blockwise QR ------------------------------------------------------------------------------


def _fold(triangle, block):
    """The triangle of both: R of the QR of what lies in ``triangle`` and ``block``."""
    return np.linalg.qr(block if triangle is None else np.vstack([triangle, block]), mode="r")


def _triangle_rows(part, triangle):
    return {
        "part": pa.array([part], pa.int64()),
        "height": pa.array([len(triangle)], pa.int32()),
        "r": pa.array([np.ascontiguousarray(triangle).tobytes()], pa.binary()),
    }


def _unpacked(height, r, length):
    return np.frombuffer(r, dtype=np.float64).reshape(height, length)


def triangle(rows, fit):
    """R of the centred rows, padded to a square."""
    length = fit.length
    schema = "part long, height int, r binary"

    def reduce_rows(batches):
        own = None
        for batch in batches:
            for _, centred in fit.rows(batch):
                own = _fold(own, fit.doubles(centred))
        if own is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(_triangle_rows(part, own))

    def reduce_group(table):
        own, part = None, table.column("part")[0].as_py() // FAN
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        heights, blobs = table.column("height"), table.column("r")
        for i in order.tolist():
            own = _fold(own, _unpacked(heights[i].as_py(), blobs[i].as_py(), length))
        return pa.table(_triangle_rows(part, own))

    parts = rows.mapInArrow(lean(reduce_rows), schema)
    for _ in range(2):
        group = F.floor(F.col("part") / FAN)
        parts = parts.groupBy(group.alias("group")).applyInArrow(reduce_group, schema)
    own = None
    for row in parts.orderBy("part").collect():  # one of FAN * FAN tasks' rows each
        own = _fold(own, _unpacked(row["height"], bytes(row["r"]), length))
    out = np.zeros((length, length))
    out[: len(own)] = own
    return out


# --- singular values and directions of a triangle ----------------------------------------------


def _reflector(x):
    """(v, beta, value): (I - beta v v') x has ``value`` first and zeros after it."""
    v = x.copy()
    norm = np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return v, 0.0, x[0]
    value = -np.copysign(norm, x[0])
    v[0] -= value
    return v, 2.0 / (v @ v), value


def bidiagonal(r):
    """(diagonal, superdiagonal, V) with R = U B V' for an upper bidiagonal B."""
    a = np.array(r, dtype=np.float64)
    d = len(a)
    rights = []
    for k in range(d):
        v, beta, value = _reflector(a[k:, k])
        if beta:
            a[k:, k + 1 :] -= beta * np.outer(v, v @ a[k:, k + 1 :])
            a[k, k], a[k + 1 :, k] = value, 0.0
        if k + 1 < d:
            w, beta, value = _reflector(a[k, k + 1 :])
            if beta:
                a[k + 1 :, k + 1 :] -= beta * np.outer(a[k + 1 :, k + 1 :] @ w, w)
                a[k, k + 1], a[k, k + 2 :] = value, 0.0
            rights.append((w, beta))
    basis = np.eye(d)
    for k in range(len(rights) - 1, -1, -1):
        w, beta = rights[k]
        if beta:
            basis[k + 1 :, k + 1 :] -= beta * np.outer(w, w @ basis[k + 1 :, k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def _dqds_step(q, e, shift):
    """One transform of the squares (q, e): new arrays and the smallest remainder.

    None if the shift lies above the smallest value, which shows as a negative remainder.
    """
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least, inverses = d, 0.0
    for i in range(n - 1):
        if d < 0:
            return None
        inverses += 1.0 / d if d > 0 else np.inf
        total = d + e[i]
        new_q[i] = total
        if total > 0:
            ratio = q[i + 1] / total
            new_e[i] = e[i] * ratio
            d = d * ratio - shift
        else:
            d = q[i + 1] - shift
        least = min(least, d)
    if d < 0:
        return None
    inverses += 1.0 / d if d > 0 else np.inf
    new_q[n - 1] = d
    return new_q, new_e, inverses


def dqds(diagonal, above):
    """The squares of the singular values of an upper bidiagonal matrix, largest first."""
    found = []
    start = ([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)
    todo = [start]
    tiny = EPS**2
    while todo:
        q, e, base = todo.pop()
        bound = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], base))
                q, e, bound = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            moved = _dqds_step(q, e, bound) if bound else None
            if moved is None:
                moved, bound = _dqds_step(q, e, 0.0), 0.0
            base += bound
            q, e, inverses = moved
            # The remainders are the inverse diagonal of (BB')^-1 before the shift was taken off, so
            # the smallest value lies above one over their sum; without a shift this stays safe.
            bound = (1.0 - 1e-3) / inverses if not bound and 0 < inverses < np.inf else 0.0
    return np.array(sorted(found, reverse=True))


class _Twisted:
    """Twisted factorisations of L D L' - value for D = q and L from a bidiagonal's rows."""

    def __init__(self, diagonal, above, value):
        n = len(diagonal)
        d, l = diagonal**2, above / diagonal[:-1]
        floor = EPS**2 * max(d.max(), (above**2).max(initial=0.0))
        self.down, s = np.zeros(max(n - 1, 0)), np.zeros(n)
        s[0] = -value
        for i in range(n - 1):
            pivot = s[i] + d[i]
            pivot = pivot if abs(pivot) > floor else floor
            self.down[i] = d[i] * l[i] / pivot
            s[i + 1] = self.down[i] * l[i] * s[i] - value
        self.up, p = np.zeros(max(n - 1, 0)), np.zeros(n)
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * l[i] * l[i] + p[i + 1]
            pivot = pivot if abs(pivot) > floor else floor
            t = d[i] / pivot
            self.up[i] = l[i] * t
            p[i] = p[i + 1] * t - value
        self.gamma = np.abs(s + p + value)

    def direction(self, twist):
        """The unit vector z with (LDL' - value) z = c e_twist, and the size of c."""
        z = np.zeros(len(self.gamma))
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(twist, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        size = np.linalg.norm(z)
        return z / size, self.gamma[twist] / size

    def best(self, basis):
        """The direction of the best twist; with a ``basis``, of the best one that lies beside it.

        Where several values nearly agree each has its own place of a small ``gamma``.
        """
        if not basis.shape[1]:
            return self.direction(int(np.argmin(self.gamma)))[0]
        widest, found = 0.0, None
        several = [self.direction(twist) for twist in range(len(self.gamma))]
        for z, _ in sorted(several, key=lambda pair: pair[1]):
            width = np.linalg.norm(z - basis @ (basis.T @ z))
            if width > widest:
                widest, found = width, z
            if width > 0.1:
                break
        return _beside(basis, found)


def _beside(basis, z):
    """``z`` made orthogonal to the columns of ``basis``, of unit length."""
    for _ in range(2):
        z = z - basis @ (basis.T @ z)
        z = z / np.linalg.norm(z)
    return z


def _block_directions(diagonal, above, squares):
    """Unit right singular vectors of an unreduced bidiagonal, one column for each square."""
    n = len(diagonal)
    out = np.zeros((n, len(squares)))
    if n == 1:
        return np.ones((1, len(squares)))
    # The factorisation needs a diagonal without zeros.
    scale = max(np.abs(diagonal).max(), np.abs(above).max())
    diagonal = np.where(np.abs(diagonal) > EPS * EPS * scale, diagonal, EPS * EPS * scale)
    for j, square in enumerate(squares):
        limit = 1e-3 * max(square, EPS * scale**2)
        near = [k for k in range(j) if squares[k] - square <= limit]
        out[:, j] = _Twisted(diagonal, above, square).best(out[:, near])
    return out


def principal(r, k):
    """(squares of all singular values, falling; the right directions of the first ``k``)."""
    size = np.abs(r).max(initial=0.0)
    if size == 0:
        return np.zeros(len(r)), np.eye(len(r))[:, :k]
    diagonal, above, basis = bidiagonal(r / size)
    # Of the size of what the reflections rounded; what they cut off has directions of its own.
    negligible = np.abs(above) <= len(r) * EPS * np.hypot(
        np.abs(diagonal).max(), np.abs(above).max(initial=0.0)
    )
    cuts = [0, *(np.flatnonzero(negligible) + 1).tolist(), len(diagonal)]
    pairs = []  # (square, block, number in the block)
    blocks = []
    for low, high in zip(cuts, cuts[1:]):
        own, over = diagonal[low:high], above[low : high - 1]
        squares = dqds(own, over)
        blocks.append((low, high, own, over, squares))
        pairs += [(s, len(blocks) - 1, i) for i, s in enumerate(squares)]
    pairs.sort(key=lambda p: (-p[0], p[1], p[2]))
    wanted = {}
    for place, (_, b, i) in enumerate(pairs[:k]):
        wanted.setdefault(b, []).append((i, place))
    inside = np.zeros((len(r), min(k, len(r))))
    for b, several in wanted.items():
        low, high, own, over, squares = blocks[b]
        found = _block_directions(own, over, squares[: max(i for i, _ in several) + 1])
        for i, place in several:
            inside[low:high, place] = found[:, i]
    directions = basis @ inside
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return np.array([p[0] for p in pairs]) * size**2, directions * signs


# --- whitening ---------------------------------------------------------------------------------


class Whitener:
    """The centring, directions and variances of a table's vectors."""

    def __init__(self, fit, squares, directions):
        self.fit, self.directions = fit, directions
        self.variances = squares[: directions.shape[1]] / fit.n
        total = squares.sum()
        self.explained = self.variances * fit.n / total if total > 0 else None
        self.flat = squares[: directions.shape[1]] <= FLAT * squares[0]
        with np.errstate(divide="ignore"):
            scales = np.where(self.flat, 0.0, 1.0 / np.sqrt(np.where(self.flat, 1.0, self.variances)))
        self.projection = directions * scales

    def whitened(self, centred):
        return self.fit.doubles(centred) @ self.projection


def train(vectors, vec_id="vec_id", vector="embedding", components=32):
    """The whitener of all fitting rows; None if there are none."""
    rows = _selected(vectors, vec_id, vector)
    fit = _fit(rows)
    if fit is None:
        return None
    squares, directions = principal(triangle(rows, fit), min(components, fit.length))
    return Whitener(fit, squares, directions)


def identity_error(vectors, tool, vec_id="vec_id", vector="embedding"):
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = tool.projection.shape[1]

    def run(batches):
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, centred in tool.fit.rows(batch):
                white = tool.whitened(centred)
                products += white.T @ white
                sums += white.sum(axis=0)
        values = np.concatenate([products.ravel(), sums])
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(np.arange(len(values))), "value": pa.array(values)}
        )

    parts = _selected(vectors, vec_id, vector).mapInArrow(lean(run), "at long, value double")
    values = np.zeros(k * k + k)
    for row in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        values[row["at"]] = row["value"]
    mean = values[k * k :] / tool.fit.n
    covariance = values[: k * k].reshape(k, k) / tool.fit.n - np.outer(mean, mean)
    kept = np.flatnonzero(~tool.flat)
    off = np.abs(covariance - np.eye(k))[np.ix_(kept, kept)]
    return float(off.max(initial=0.0))


def components(vectors, tool, vec_id="vec_id", vector="embedding"):
    """One row per fitting row and component, with exact deviations and whitened coordinates."""
    spark = vectors.sparkSession
    if tool is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(vectors, tool, vec_id, vector)
    k = tool.projection.shape[1]
    flat = np.flatnonzero(tool.flat)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for kept, centred in tool.fit.rows(batch):
                white = tool.whitened(centred)
                no_value = np.zeros(white.shape, dtype=bool)
                no_value[:, flat] = True
                many = len(kept) * k
                share = [None] * many if tool.explained is None else np.tile(tool.explained, len(kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(kept, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))),
                        pa.array(np.full(many, tool.fit.n)),
                        pa.array(_deviations(centred), pa.int64()).take(
                            pa.array(np.repeat(np.arange(len(kept)), k))
                        ),
                        pa.array(white.ravel(), mask=no_value.ravel()),
                        pa.array(share, pa.float64()),
                        pa.array(np.full(many, error)),
                    ],
                    names=[part.split()[0] for part in OUT.split(", ")],
                )

    return _selected(vectors, vec_id, vector).mapInArrow(lean(run), OUT)


def whitened_vectors(vectors, tool, vec_id="vec_id", vector="embedding"):
    """vec_id and the whitened vector of each fitting row; a flat direction's coordinate is 0."""
    if tool is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, whitened array<double>")

    def run(batches):
        for batch in batches:
            for kept, centred in tool.fit.rows(batch):
                white = tool.whitened(centred)
                at = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * white.shape[1])
                lists = pa.ListArray.from_arrays(at, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(kept)), lists], names=["vec_id", "whitened"]
                )

    rows = _selected(vectors, vec_id, vector)
    return rows.mapInArrow(lean(run), "vec_id long, whitened array<double>")
