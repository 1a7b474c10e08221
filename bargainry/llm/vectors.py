"""Whole-number vectors in shards, and searches of query blocks against all shards, in waves.

A shard is an index of a bounded number of rows, dealt by hash, so that copies of one vector
spread over all shards.  It is stored as records: a head, then the rows.  A search sends each
query to one shard first, then to 16, to 256 and so on; before each wave, the queries take
along the scores that a row has to reach by what was found so far.  In a wave a task reads
its shards one after the other, each followed by its queries, so that it holds one shard and
one block of queries at a time, however many there are.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, map_batches, materialize, semi_by_size, task_count

#: Of a shard: numbers and rows at most.  Of a stored record: the same.  Queries handled at once.
SHARD_NUMBERS, SHARD_ROWS, CHUNK_NUMBERS, CHUNK_ROWS, BLOCK = 1 << 22, 1 << 15, 1 << 14, 256, 512

#: Shards of the first wave, and how many times more the next has.
WAVE = 16

LOW, HIGH = -(1 << 63), (1 << 63) - 1

RECORD = "dim int, shard int, kind int, part long, blob binary, q string, id long, label long, vec array<long>, floors array<long>, caps array<long>"
HIT = "q string, j int, id long, score long"
_HIT = pa.schema([("q", pa.string()), ("j", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_KEPT = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("part", pa.int64()), ("blob", pa.binary())])


def whole_numbers(df: DataFrame, asks: Column, id: str, vector: str, scale: int, label: Column | None = None) -> DataFrame:
    """A written table of id, label, asks, vec (floor of ``scale`` times each component), dim and salt.

    Only rows with an id ask.  Rows that have no vector, or a component that is null or not finite, are left out.
    """
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    out = df.where(fine).select(F.col(id).cast("long").alias("id"), (F.lit(None) if label is None else label).cast("long").alias("label"), (asks & F.col(id).isNotNull()).alias("asks"), vec.alias("vec"))
    return materialize(out.withColumn("dim", F.size("vec")).withColumn("salt", F.rand(7)))  # written, so that a row keeps its salt


def questions(rows: DataFrame) -> DataFrame:
    """The rows that ask: q (id, label and vector in a digest; a row that is repeated asks once), id, label, vec, dim."""
    said = F.concat_ws(" ", F.col("id"), F.coalesce(F.col("label").cast("string"), F.lit("-")), F.array_join("vec", " "))
    return rows.where("asks").drop("asks", "salt").withColumn("q", F.sha2(said, 256)).dropDuplicates(["q"])


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """In as few bytes as hold them."""
    for kind in (np.int16, np.int32):
        if numbers.size and np.iinfo(kind).min <= numbers.min() and numbers.max() <= np.iinfo(kind).max:
            return numbers.astype(kind)
    return numbers


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: as doubles where these hold every sum, else as longs."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Index:
    """A shard: rows, in the order that ``arrange`` gave them, with what a search needs besides.

    Subclasses give ``arrange`` (the order of the rows, their further arrays, the head's
    arrays) and ``probe`` (yield candidates of a block).
    """

    def __init__(self, head: dict[str, np.ndarray], chunks: list[dict[str, np.ndarray]]):
        self.head = head
        self.rows = {k: np.concatenate([c[k] for c in chunks]) for k in chunks[0]}

    @staticmethod
    def arrange(vec: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, dict, dict]:
        raise NotImplementedError

    def probe(self, block: Block) -> None:
        raise NotImplementedError


class Block:
    """Queries in a shard: the ``k`` best rows of each, for each of its bounds, and the scores still to reach."""

    def __init__(self, k: int, index: Index, ask: dict):
        self.k, self.index, self.vec, self.label, self.id = k, index, ask["vec"], ask["label"], ask["id"]
        self.floors, self.caps = ask["floors"], ask["caps"]  # n x bounds; without a bound, no score fits
        n = self.floors.size
        self.score, self.row = np.zeros((n, k), np.int64), np.full((n, k), -1)

    def reach(self) -> np.ndarray:
        """The lowest score by which a row may still be among the best, for any bound of a query; an equal one may have a smaller id."""
        return self.floors.min(axis=1)

    def offer(self, asks: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """Scored rows, of any order; ``asks`` numbers the queries of the block."""
        own = (self.index.rows["id"][rows] == self.id[asks]) & ~self.index.rows["none"][rows]
        asks, rows, scores = asks[~own], rows[~own], scores[~own]
        for j in range(self.floors.shape[1]):
            fit = (scores >= self.floors[asks, j]) & (scores <= self.caps[asks, j])
            if fit.any():
                self._keep(asks[fit] * self.floors.shape[1] + j, rows[fit], scores[fit])

    def _keep(self, slot: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        met = np.unique(slot)
        old = self.row[met] >= 0
        slot = np.concatenate([slot, np.repeat(met, self.k)[old.ravel()]])
        row = np.concatenate([row, self.row[met][old]])
        score = np.concatenate([score, self.score[met][old]])
        order = np.lexsort((self.index.rows["rank"][row], ~score, slot))
        slot, row, score = slot[order], row[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = place < self.k
        self.row[slot[best], place[best]], self.score[slot[best], place[best]] = row[best], score[best]
        full = slot[place == self.k - 1]
        floors = self.floors.reshape(-1)
        floors[full] = np.maximum(floors[full], self.score[full, -1])

    def found(self, q: list[str]) -> pa.RecordBatch:
        slot, place = np.nonzero(self.row >= 0)
        ask, j = np.divmod(slot, self.floors.shape[1])
        row = self.row[slot, place]
        rows = self.index.rows
        id = pa.array(rows["id"][row], pa.int64(), mask=rows["none"][row])
        return pa.record_batch([pa.array([q[a] for a in ask], pa.string()), pa.array(j, pa.int32()), id, pa.array(self.score[slot, place], pa.int64())], schema=_HIT)


def build(rows: DataFrame, kind: type[Index], shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """The records of all shards, and how many shards each length of vectors has; both written to the shared folder."""
    spark = rows.sparkSession
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_NUMBERS) / F.greatest(F.col("dim"), F.lit(1)))))
    least = F.least(F.lit(task_count(spark)), F.ceil(F.col("n") / 1024))  # small tables use all tasks
    dims = materialize(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.greatest(F.ceil(F.col("n") / most), least).cast("int").alias("shards")))

    def index(found: pa.Table) -> pa.Table:
        try:
            dim, shard = found["dim"][0].as_py(), found["shard"][0].as_py()
            vec = matrix(found["vec"].combine_chunks(), dim)
            none, unlabelled = (np.asarray(found[c].is_null()) for c in ("id", "label"))
            id, label = (np.asarray(found[c].fill_null(0), np.int64) for c in ("id", "label"))
            rank = np.empty(len(id), np.int64)
            rank[np.lexsort((id, none))] = np.arange(len(id))
            order, more, head = kind.arrange(vec, label)
            rows = {"vec": narrow(vec), "id": id, "none": none, "label": label, "unlabelled": unlabelled, "rank": rank}
            rows = {k: v[order] for k, v in rows.items()} | more
            chunk = min(CHUNK_ROWS, max(1, CHUNK_NUMBERS // max(1, dim)))
            blobs = [pack(**head)] + [pack(**{k: v[at : at + chunk] for k, v in rows.items()}) for at in range(0, len(id), chunk)]
            n = len(blobs)
            return pa.table([[dim] * n, [shard] * n, [0] + [1] * (n - 1), list(range(n)), blobs], schema=_KEPT)
        finally:
            give_back()

    hashed = F.pmod(F.xxhash64("id", "salt"), F.col("shards")).cast("int")
    dealt = semi_by_size(rows, dims, ["dim"], "inner").select("dim", hashed.alias("shard"), "id", "label", "vec")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(index, _KEPT_SQL)), dims


_KEPT_SQL = "dim int, shard int, kind int, part long, blob binary"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of records of the same shard and kind."""
    keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    for at, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        yield tuple(keys[at]), at, end


def _answers(kind: type[Index], k: int) -> Callable:
    def run(batches):
        shard, parts, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for (dim, number, what), at, end in _runs(batch):
                piece = batch.slice(at, end - at)
                if shard != (dim, number):
                    shard, parts, index = (dim, number), [], None
                if what < 2:
                    parts += piece.column("blob").to_pylist()
                    continue
                if index is None:
                    index, parts = kind(unpack(parts[0]), [unpack(x) for x in parts[1:]]), []
                for start in range(0, len(piece), BLOCK):
                    some = piece.slice(start, BLOCK)
                    width = len(some.column("floors")[0])
                    ask = {c: np.array(matrix(some.column(c), w)) for c, w in (("vec", dim), ("floors", width), ("caps", width))}
                    ask |= {c: np.asarray(some.column(c).fill_null(LOW), np.int64) for c in ("id", "label")}
                    block = Block(k, index, ask)
                    index.probe(block)
                    yield block.found(some.column("q").to_pylist())

    return run


def best(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query and bound: higher scores first, ties by smaller id, rows without one last; with their rank."""
    order = Window.partitionBy("q", "j").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: tuple[DataFrame, DataFrame], asks: DataFrame, kind: type[Index], k: int, bounds: int = 1) -> DataFrame:
    """q, j, id, score, rank: of each query and each of its bounds, the ``k`` best rows that the index allows.

    ``asks`` has q, id, label, vec, dim, floors and caps (arrays of ``bounds`` longs; a score
    has to be between them).
    """
    records, dims = index
    spark = records.sparkSession
    asks = materialize(semi_by_size(asks, dims, ["dim"], "inner"))
    most = dims.agg(F.max("shards")).first()[0] or 0
    found, lo, hi = None, 0, 1
    while lo < most:
        wave = asks.where(F.col("shards") > lo)
        if found is not None:
            reached = found.groupBy("q", "j").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
            reached = reached.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("j", "last"))).alias("reached"))
            higher = F.expr("transform(floors, (x, j) -> greatest(x, try_element_at(reached, j)))")  # greatest skips a null
            wave = wave.join(reached, "q", "left").withColumn("floors", F.when(F.col("reached").isNull(), F.col("floors")).otherwise(higher))
        steps = F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("shards")) - 1)
        wave = wave.withColumn("step", F.explode(steps)).withColumn("shard", F.pmod(F.pmod(F.xxhash64("q"), F.col("shards")) + F.col("step"), F.col("shards")).cast("int"))
        wave = wave.select("dim", "shard", F.lit(2).alias("kind"), F.xxhash64("q").alias("part"), F.lit(None).cast("binary").alias("blob"), "q", "id", "label", "vec", "floors", "caps")
        stream = records.unionByName(wave, allowMissingColumns=True)
        stream = stream.repartition(task_count(spark), "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "part")
        hits = map_batches(stream, _answers(kind, k), HIT)
        found = materialize(best(hits if found is None else hits.unionByName(found.drop("rank")), k))
        lo, hi = hi, hi * WAVE
    return found if found is not None else spark.createDataFrame([], HIT + ", rank int")
