"""Hard negatives by a pivot table: distances to a few rows bracket the scores of all others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .vectors import CHUNK_ROWS, HIGH, LOW, Block, Index, products

#: Pivots of a shard.
PIVOTS = 8


class PivotTable(Index):
    """Rows with their distances to the shard's pivots.

    A row of length |x| gets sqrt(M^2 - |x|^2) as a further component, M being the longest
    row of the shard, and a query gets 0: then |q - x|^2 = |q|^2 + M^2 - 2qx, so that the
    score follows from the distance.  By the triangle inequality the distance is at least
    the difference of the two distances to any pivot, and at most their sum.
    """

    same_label = False

    @staticmethod
    def arrange(vec: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, dict, dict]:
        real = vec.astype(np.float64)
        squares = (real**2).sum(axis=1)
        most = squares.max()
        real = np.column_stack([real, np.sqrt(most - squares)])
        pivots, away = [], []
        nearest = np.full(len(real), np.inf)
        for _ in range(min(PIVOTS, len(real))):
            pivots.append(real[nearest.argmax()])  # the row farthest from all pivots so far
            away.append(np.sqrt(((real - pivots[-1]) ** 2).sum(axis=1)))
            nearest = np.minimum(nearest, away[-1])
        order = np.argsort(away[0], kind="stable")  # so that a chunk's rows are about as far from the first pivot
        return order, {"away": np.stack(away, axis=1)[order]}, {"pivots": np.array(pivots), "square": np.array([most])}

    def bracket(self, away: np.ndarray, near: np.ndarray, far: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score of queries (their distances to pivots) with rows that are ``near`` to ``far`` from these."""
        least, most = np.zeros((len(away), len(near))), np.full((len(away), len(near)), np.inf)
        for j in range(away.shape[1]):
            own = away[:, j, None]
            np.maximum(least, np.maximum(own - far[:, j], near[:, j] - own), out=least)
            np.minimum(most, own + far[:, j], out=most)
        total = (squares + self.head["square"][0])[:, None]
        slack = 1 + 1e-6 * total  # more than the distances of doubles are off
        return (total - most**2) / 2 - slack, (total - least**2) / 2 + slack

    def probe(self, block: Block) -> None:
        """Chunks and then rows whose bracket is out of the bounds are left; the scores of the others are computed."""
        asked = block.vec.astype(np.float64)
        squares = (asked**2).sum(axis=1)
        pivots = self.head["pivots"]
        away = np.sqrt(np.maximum(0, squares[:, None] + (pivots**2).sum(axis=1) - 2 * asked @ pivots[:, :-1].T))
        rows, starts = self.rows, np.arange(0, len(self.rows["id"]), CHUNK_ROWS)
        low, high = self.bracket(away, np.minimum.reduceat(rows["away"], starts), np.maximum.reduceat(rows["away"], starts), squares)
        most = block.caps.max(axis=1)
        for chunk in np.argsort(-high.max(axis=0)):
            going = np.flatnonzero((high[:, chunk] >= block.reach()) & (low[:, chunk] <= most))
            if not len(going):
                continue
            part = slice(starts[chunk], starts[chunk] + CHUNK_ROWS)
            least, best = self.bracket(away[going], rows["away"][part], rows["away"][part], squares[going])
            same = rows["label"][part] == block.label[going, None]
            maybe = (best >= block.reach()[going, None]) & (least <= most[going, None]) & (same if self.same_label else ~same)
            if maybe.any():
                scores = products(block.vec[going], rows["vec"][part])
                maybe &= scores >= block.reach()[going, None]
                ask, row = np.nonzero(maybe)
                block.offer(going[ask], row + starts[chunk], scores[ask, row])


class SameLabel(PivotTable):
    same_label = True


def mine(
    df: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    shard_rows: int = vectors.SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows that meet ``anchors``; their positives the ``positives`` best other
    rows of the same label; for each, the ``negatives`` best rows of another label whose score
    is from ``least`` to ``most`` per cent of the positive's.  Scores are inner products of
    floor(``scale`` times x), whole numbers that have to fit in a long with two digits to
    spare.  Ties go to the smaller id; rows without an id come last among ties and are no
    anchors.  A row is not another one if it has the anchor's id; a repeated anchor counts
    once, rows of one id with different vectors or labels are anchors one by one; repeated
    rows are found as often as they are there.  Rows take no part whose label or vector is null or whose vector has a
    component that is null or not finite.  Vectors, however long, meet those of their own
    length.  Positives of a negative score have no negatives, as ``least`` per cent of it is
    more than the score.  Further columns have no influence; an empty table gives no rows.
    """
    rows = vectors.whole_numbers(df.where(label.isNotNull()), anchors, id, vector, scale, label)
    index = vectors.build(rows, PivotTable, shard_rows)
    asks = vectors.questions(rows)
    wide = asks.withColumn("floors", F.array(F.lit(LOW))).withColumn("caps", F.array(F.lit(HIGH)))
    near = vectors.search(index, wide, SameLabel, positives)
    near = near.where("score >= 0").select("q", (F.col("rank") - 1).alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    bands = near.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("j", "positive_score"))).alias("scores"))
    each = f"transform(sequence(0, {positives - 1}), j -> coalesce({{}}, {{}}))"  # without a positive, no score fits
    floors = F.expr(each.format(f"({least} * try_element_at(scores, j) + 99) div 100", HIGH))
    caps = F.expr(each.format(f"{most} * try_element_at(scores, j) div 100", f"{HIGH} * -1"))
    hard = vectors.search(index, asks.join(bands, "q").withColumns({"floors": floors, "caps": caps}).drop("scores"), PivotTable, negatives)
    names = asks.select("q", F.col("id").alias("anchor_id"))
    out = hard.join(near, ["q", "j"]).join(names, "q")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
