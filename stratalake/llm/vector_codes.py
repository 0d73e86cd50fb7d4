"""Vector codes: every vector becomes one byte a part, the number of the nearest entry of that part position's codebook.

Components become integers (floor of 256 times the component), vectors are cut into equal consecutive parts, and each part position has a codebook of its
own: first that part of the vectors with the smallest ids, then, for a number of rounds, the componentwise floor of the mean of the parts nearest to each
entry. The nearest entry is found in a vantage-point tree over a codebook's entries. A batch goes down the tree once for a first candidate and a
second time by branch and bound: a child is passed over only if the ring of distances in which its entries lie, its radii rounded outwards, is farther than
the candidate; equal bounds are visited, since the lower number wins a tie. Distances that decide are integers, so rounding can only cost visits.

Tasks add up the parts of each entry before the shuffle; the driver gets codebooks and sums, whose size is parts x entries x components whatever the input.

Defined cases: a row whose vector is null, empty or holds a null or non-finite component is dropped, and so is one whose length isn't that of the vector
with the least id, or can't be cut into the parts. Components beyond 2^18 count as 2^18, so that errors fit a long. Of rows that repeat an id the least vector
is an entry; every row is coded. Rows with a null id are coded, but are no entry. With fewer ids than entries the codebook is shorter. An empty table gives an
empty result; columns other than vec_id, embedding and label are ignored, and label may be absent from what encode gets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import bounded, table, written

SCALE = 256
MOST = 1 << 26  # of an integer component
LEAF = 8


@dataclass(frozen=True)
class Plan:
    parts: int = 16
    entries: int = 64  # at most 256
    rounds: int = 2


DEFAULT = Plan()


# ------------------------------------------------------------------ the tree


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf), np.inf)


def _down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf), -np.inf), 0.0)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as integers, (points, entries)."""
    found = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        gap = points[:, k, None] - entries[None, :, k]
        found += gap * gap
    return found


class Tree:
    """A vantage-point tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf, self.nodes = entries, leaf, []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        """Number of the node over these entries: (members, None) at a leaf, else ([vantage], its children with the rings they lie in)."""
        at = len(self.nodes)
        self.nodes.append((members, None))
        if len(members) > self.leaf:
            # The entry farthest from the others on the whole sees them in the widest ring.
            vantage = members[int(_squares(self.entries[members], self.entries[members]).astype(np.float64).sum(axis=1).argmax())]
            rest = members[members != vantage]
            away = _squares(self.entries[rest], self.entries[vantage][None])[:, 0]
            order = np.argsort(away, kind="stable")
            halves = [(np.sort(rest[part]), away[part]) for part in (order[: len(order) // 2], order[len(order) // 2 :])]
            children = [(self._grow(own), float(_down(d.min()[None])[0]), float(_up(d.max()[None])[0])) for own, d in halves]
            self.nodes[at] = (np.array([vantage]), children)
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest entry, the lower one of equals; squared distance) of each point, and how many distances were computed."""
        n, met = len(points), 0
        best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.entries))

        def meet(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
            nonlocal met
            met += len(rows) * len(members)
            squares = _squares(points[rows], self.entries[members])
            first = squares.argmin(axis=1)
            least, number = squares[np.arange(len(rows)), first], members[first]
            better = (least < best[rows]) | ((least == best[rows]) & (number < which[rows]))
            best[rows[better]], which[rows[better]] = least[better], number[better]
            return least

        # Once down to a leaf for a first candidate, then wherever something as near may be.
        for bound in (False, True):
            todo = [(0, np.arange(n))]
            while todo:
                at, rows = todo.pop()
                members, children = self.nodes[at]
                if not len(rows):
                    continue
                squares = meet(rows, members)
                if children is None:
                    continue
                low, high = _down(squares), _up(squares)
                if bound:
                    reach = _up(best[rows])
                    for child, inner, outer in children:
                        gap = np.maximum(np.nextafter(low - outer, -np.inf), np.nextafter(inner - high, -np.inf))
                        todo.append((child, rows[gap <= reach]))
                else:
                    (near, _, edge), (far, _, _) = children
                    inside = low <= edge
                    todo += [(near, rows[inside]), (far, rows[~inside])]
        return which, best, met


# ------------------------------------------------------------------ batches


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Integer components, (rows, dims), of vectors without nulls and of one length."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(np.clip(values * SCALE, -MOST, MOST)).astype(np.int64)


def _assigned(batch: pa.RecordBatch, trees: list[Tree], dims: int):
    whole = _integers(batch.column("embedding"), dims)
    width = dims // len(trees)
    for part, tree in enumerate(trees):
        own = whole[:, part * width : (part + 1) * width]
        yield own, *tree.nearest(own)[:2]


def _sums(books: np.ndarray):
    """Tasks: (place in the codebooks, sum of the components that fell there, their number)."""
    parts, entries, width = books.shape

    def run(batches):
        trees = [Tree(b) for b in books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, (own, which, _) in enumerate(_assigned(batch, trees, parts * width)):
                np.add.at(total[part], which, own)
                count[part] += np.bincount(which, minlength=entries)
        used = np.repeat(count.ravel() > 0, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(total.ravel()[used]), pa.array(np.repeat(count.ravel(), width)[used])], names=["place", "total", "n"])

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        trees = [Tree(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = np.zeros(batch.num_rows, "U1"), np.zeros(batch.num_rows, np.int64)
            for part, (_, which, squares) in enumerate(_assigned(batch, trees, parts * width)):
                codes = digits[which] if not part else np.char.add(codes, digits[which])
                error += squares
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


# ------------------------------------------------------------------ the operator


@dataclass(frozen=True)
class Codebooks:
    """entries: integer components, (parts, entries, components of a part); of no vectors, none."""

    entries: np.ndarray

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(vectors: DataFrame, plan: Plan = DEFAULT, dims: int | None = None) -> DataFrame:
    """The rows whose vectors can be coded: vec_id, label, embedding."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sized = (F.size(x) == dims) if dims else (F.size(x) > 0) & (F.size(x) % plan.parts == 0)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.select("vec_id", label, "embedding").where(x.isNotNull() & sized & F.coalesce(sound, F.lit(False)))


def fit(vectors: DataFrame, plan: Plan = DEFAULT) -> Codebooks:
    """The codebooks after plan.rounds rounds over all vectors."""
    kept = whole(vectors, plan)
    # At most plan.entries ids and vectors reach the driver.
    ids = [r.vec_id for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(plan.entries).collect()]
    if not ids:
        return Codebooks(np.zeros((plan.parts, 0, 0), np.int64))
    first = sorted((r.vec_id, r.v) for r in kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("v")).collect())
    dims = len(first[0][1])
    start = _integers(pa.array([v for _, v in first if len(v) == dims]), dims)
    books = start.reshape(len(start), plan.parts, -1).transpose(1, 0, 2).copy()
    kept = whole(vectors, plan, dims)
    for _ in range(plan.rounds):
        sums = kept.select("embedding").mapInArrow(_sums(books), "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        flat = books.reshape(-1)  # a view: entries that no part is nearest to stay
        for r in sums.collect():
            flat[r.place] = r.total // r.n
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks, plan: Plan = DEFAULT) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance to the entries) of every row that can be coded."""
    kept = whole(vectors, plan, books.dims or None)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    if not books.entries.size:
        kept = kept.limit(0)
    return kept.mapInArrow(_codes(books.entries), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with the column embedding: the entries that code names, as components again (integers divided by 256)."""
    parts, entries, width = books.entries.shape
    flat = F.lit([x / SCALE for x in books.entries.ravel().tolist()]) if entries else F.array().cast("array<double>")
    number = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("embedding", F.flatten(F.array(*(F.slice(flat, (number(p) + p * entries) * width + 1, width) for p in range(parts)))))


@bounded
def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    coded = written(encode(vectors, books), "codes")
    # Labels may be many or one: the sums are small where they are few, and adaptive execution splits a label that is hot where they aren't.
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "same")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_ROUND = """
d{n} AS (SELECT p.vec_id, p.part, min({{'d': list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT, 'e': c.e}}) AS m FROM p JOIN c{n} c ON c.part = p.part GROUP BY ALL),
"""
_MEANS = """
s{n} AS (SELECT part, e, i, sum(x)::BIGINT AS s, count(*) AS k FROM (SELECT p.part, d.m.e AS e, unnest(range(1, len(p.v) + 1)) AS i, unnest(p.v) AS x FROM d{n} d JOIN p ON p.vec_id = d.vec_id AND p.part = d.part) GROUP BY ALL),
g{n} AS (SELECT part, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS v FROM s{n} GROUP BY ALL),
c{m} AS (SELECT c.part, c.e, coalesce(g.v, c.v) AS v FROM c{n} c LEFT JOIN g{n} g ON g.part = c.part AND g.e = c.e),
"""
SQL = (
    """
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, list_transform(range(1, len(embedding) // 16 + 1), lambda i: floor(256 * embedding[part * (len(embedding) // 16) + i]::DOUBLE)::BIGINT) AS v FROM kept, range(16) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
c0 AS (SELECT p.part, f.e, p.v FROM f JOIN p ON p.vec_id = f.vec_id),
"""
    + "".join(_ROUND.format(n=n) + _MEANS.format(n=n, m=n + 1) for n in (0, 1))
    + _ROUND.format(n=2)
    + """
o AS (SELECT k.vec_id, k.label, string_agg(format('{:02x}', d.m.e), '' ORDER BY d.part) AS code, sum(d.m.d)::BIGINT AS error FROM d2 d JOIN kept k ON k.vec_id = d.vec_id GROUP BY ALL),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM c2))
SELECT o.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY o.label))::BIGINT AS label_error, h.codebooks_sha256 FROM o, h
"""
)
