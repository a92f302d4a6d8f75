"""Near-duplicate vectors by the epsilon grid order join.

Cosine t between unit vectors is the distance ``epsilon = sqrt(2 - 2 t)``.  Vectors are turned
onto leading principal directions and sorted by the cells of a grid of width epsilon in these
(the epsilon grid order).  The sorted sequence is numbered over all partitions and cut into blocks of
equal size.  Two blocks are compared only if their bounding boxes in the leading directions are within
epsilon; boxes meet in the grid cells of the first ``MEET`` directions that they reach into, so
blocks that are apart in one of these never meet.  Inside a pair of blocks
the sequence is halved again and again, and intervals that are provably further apart are
skipped.  Remaining intervals are compared by dense products in double precision.  Pairs are
never written: a task returns, for each vector with links, their number and the smallest
id it is connected with inside the task; sums and components follow from these.

Every link at or above ``threshold`` is found, whatever the fitted directions are; they only
decide how much can be skipped.  They are fitted on at most about ``SAMPLE`` vectors.

Equal unit vectors are one vector with a multiplicity.  Vectors that are null, empty, zero or
have null or non-finite components link with nothing, nor do rows without an id; vectors of
different length don't link.  Repeated rows are vectors of their own.  An empty table gives an
empty result.  Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_rank
from ..plans.staging import stage
from .batches import consecutive
from .components import components
from .ordering import HASH_BITS, hash60

THRESHOLD = 0.95
#: Vectors that the directions are fitted on, leading directions, vectors of a block and of an interval.
SAMPLE, LEADING, BLOCK, INTERVAL = 10_000, 8, 4096, 512
#: Directions in whose cells boxes meet.
MEET = 3


def unit_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, n (components) and unit (doubles as bytes; null where the vector has no direction)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, sizes = [], []
            for row in batch.column(1):
                unit = None
                if row.is_valid and len(row.values) and not row.values.null_count:
                    x = row.values.to_numpy(zero_copy_only=False).astype(float)
                    most = np.abs(x).max()
                    if np.isfinite(most) and most > 0:
                        x = x / most
                        unit = (x / np.sqrt(x @ x) + 0.0).tobytes()  # + 0.0: no negative zeros
                units.append(unit)
                sizes.append(len(row.values) if unit else 0)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "n": pa.array(sizes, pa.int32()), "unit": pa.array(units, pa.binary())})

    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors[vector].cast("array<double>").alias("_v"))
    return rows.mapInArrow(run, "vec_id bigint, n int, unit binary")


def leading_directions(units: DataFrame, sample: int = SAMPLE, leading: int = LEADING) -> dict[int, np.ndarray]:
    """By vector length: ``leading`` orthonormal directions, principal ones of a bounded sample."""
    total = units.count()
    bound = int(min(1.0, sample / max(total, 1)) * (1 << HASH_BITS))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (n,), rows in consecutive(batches, ["n"]):
            x = np.frombuffer(b"".join(rows.column("unit").to_pylist())).reshape(-1, n)
            x = x - x.mean(0)
            values, axes = np.linalg.eigh(x.T @ x)
            axes = axes[:, ::-1][:, : min(leading, n)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int32()), "axes": [np.ascontiguousarray(axes).tobytes()]})

    picked = units.filter(hash60(F.lit("ego"), F.col("vec_id")) <= bound)
    # The one task that sees the sample; some lengths may be missing in it.
    fitted = {r["n"]: np.frombuffer(r["axes"]).reshape(r["n"], -1) for r in picked.repartition(1).sortWithinPartitions("n").mapInArrow(fit, "n int, axes binary").collect()}
    return fitted


def _boxes(coords: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    return coords[at:end].min(0), coords[at:end].max(0)


class _Tile:
    """The links between two blocks (or inside one)."""

    def __init__(self, units: np.ndarray, coords: np.ndarray, many: np.ndarray, split: int, threshold: float, epsilon: float):
        """Rows before ``split`` are the first block; ``split`` 0: one block with itself."""
        self.units, self.coords, self.many, self.threshold, self.epsilon = units, coords, many, threshold, epsilon
        self.links = np.zeros(len(units), np.int64)
        self.found: list[tuple[int, int, np.ndarray]] = []
        self.boxes: dict[tuple[int, int], tuple] = {}
        n = len(units)
        if split:
            self._join(0, split, split, n)
        else:
            self._join(0, n, 0, n)

    def _box(self, at: int, end: int):
        if (at, end) not in self.boxes:
            self.boxes[at, end] = _boxes(self.coords, at, end)
        return self.boxes[at, end]

    def _join(self, a: int, b: int, c: int, d: int) -> None:
        stack = [(a, b, c, d)]
        while stack:
            a, b, c, d = stack.pop()
            (low, high), (low2, high2) = self._box(a, b), self._box(c, d)
            gap = np.maximum(0, np.maximum(low - high2, low2 - high))
            if gap @ gap > self.epsilon**2 + 1e-9:
                continue
            if max(b - a, d - c) <= INTERVAL:
                self._compare(a, b, c, d)
            elif (a, b) == (c, d):
                m = (a + b) // 2
                stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                m = (a + b) // 2
                stack += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                stack += [(a, b, c, m), (a, b, m, d)]

    def _compare(self, a: int, b: int, c: int, d: int) -> None:
        near = self.units[a:b] @ self.units[c:d].T >= self.threshold
        if a == c:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links[a:b] += near @ self.many[c:d]
        if a != c:
            self.links[c:d] += near.T @ self.many[a:b]
        self.found.append((a, c, near))

    def roots(self) -> np.ndarray:
        """For each row the first row that it is connected with."""
        label = np.arange(len(self.units))
        while True:
            before = label.copy()
            for a, c, near in self.found:
                rows, columns = label[a : a + near.shape[0]], label[c : c + near.shape[1]]
                least = np.minimum(np.where(near, columns[None, :], len(label)).min(1), rows)
                np.minimum.at(label, rows.copy(), least)
                least = np.minimum(np.where(near, label[a : a + near.shape[0]][:, None], len(label)).min(0), columns)
                np.minimum.at(label, columns.copy(), least)
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                return label


def link_vectors(vectors: DataFrame, vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    all_units = stage(unit_vectors(vectors, vector).withColumn("same", F.sha2("unit", 256)), "units")
    usable = all_units.filter("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    # One row per class: a repeated id may bring its vector more than once.
    first = usable.select("same", "n", "unit", "vec_id").join(classes.select("same", F.col("rep").alias("vec_id"), "many"), ["same", "vec_id"]).dropDuplicates(["same"])
    reps = stage(first.select("vec_id", "n", "unit", "many"), "classes")
    axes = leading_directions(reps)
    names = [f"c{i}" for i in range(LEADING)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = np.zeros((batch.num_rows, LEADING))
            sizes = batch.column("n").to_numpy()
            units = batch.column("unit").to_pylist()
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                turn = axes.get(n, np.eye(n, min(n, LEADING)))
                coords[at, : turn.shape[1]] = np.frombuffer(b"".join(units[i] for i in at)).reshape(-1, n) @ turn
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(coords[:, i]) for i in range(LEADING))], names=[*batch.schema.names, *names])

    ddl = "vec_id bigint, n int, unit binary, many bigint, " + ", ".join(f"{c} double" for c in names)
    order = ["n", *[F.floor(F.col(c) / epsilon) for c in names], "vec_id"]
    placed = global_rank(reps.mapInArrow(place, ddl), order, "rank").withColumn("block", F.floor((F.col("rank") - 1) / block).cast("bigint"))
    boxes = stage(placed.groupBy("block", "n").agg(
        *[F.min(c).alias(f"low_{c}") for c in names], *[F.max(c).alias(f"high_{c}") for c in names]), "boxes")

    # Blocks whose boxes are within epsilon.  Sorted blocks are narrow in the first directions, so
    # a box reaches into few cells; one side is widened by a cell.
    cell = lambda c: F.floor(F.col(c) / epsilon)
    left, right = boxes, boxes
    for i, c in enumerate(names[:MEET]):
        left = left.withColumn(f"cell{i}", F.explode(F.sequence(cell(f"low_{c}"), cell(f"high_{c}"))))
        right = right.withColumn(f"cell{i}", F.explode(F.sequence(cell(f"low_{c}") - 1, cell(f"high_{c}") + 1)))
    left, right = left.alias("a"), right.alias("b")
    gap = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col(f"a.low_{c}") - F.col(f"b.high_{c}"), F.col(f"b.low_{c}") - F.col(f"a.high_{c}")), F.lit(2)) for c in names),
        F.lit(0.0),
    )
    near = left.join(right, ["n", *[f"cell{i}" for i in range(MEET)]]).filter((F.col("a.block") <= F.col("b.block")) & (gap <= epsilon**2 + 1e-9))
    tiles = stage(near.select("n", F.col("a.block").alias("a"), F.col("b.block").alias("b")).distinct(), "tiles")
    columns = ["vec_id", "n", "unit", "many", *names]
    # A block of the sequence may hold the end of one vector length and the start of the next.
    first, second = (placed.select(F.col("block").alias(side), *columns) for side in ("a", "b"))
    members = (
        tiles.join(first, ["n", "a"]).select("a", "b", F.lit(0).alias("side"), *columns)
        .union(tiles.filter("a < b").join(second, ["n", "b"]).select("a", "b", F.lit(1).alias("side"), *columns))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in consecutive(batches, ["n", "a", "b"]):
            n = rows.column("n")[0].as_py()
            units = np.frombuffer(b"".join(rows.column("unit").to_pylist())).reshape(-1, n)
            coords = np.column_stack([rows.column(c).to_numpy() for c in names])
            side = rows.column("side").to_numpy()
            tile = _Tile(units, coords, rows.column("many").to_numpy(), int((side == 0).sum()) if side[-1] else 0, threshold, epsilon)
            at = np.flatnonzero(tile.links)
            if len(at):
                ids = rows.column("vec_id").to_numpy()
                yield pa.RecordBatch.from_pydict({"vec_id": ids[at], "links": tile.links[at], "root": ids[tile.roots()[at]]})

    partial = stage(
        members.repartition("n", "a", "b").sortWithinPartitions("n", "a", "b", "side", *order[1:])
        .mapInArrow(compare, "vec_id bigint, links bigint, root bigint"), "partial")
    joined = components(partial.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    sums = partial.groupBy("vec_id").agg(F.sum("links").alias("links"))
    by_class = (
        classes.join(sums.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(joined.withColumnRenamed("u", "rep"), "rep", "left")
        .select("same", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("v", "rep").alias("component_id"))
    )
    keyed = all_units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("same")).alias("same"))
    out = keyed.join(stage(by_class, "vector-classes"), "same", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
