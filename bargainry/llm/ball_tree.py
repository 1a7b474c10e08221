"""Exact top-k search by inner product: branch and bound over a ball tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .vectors import HIGH, LOW, Block, Index, products

#: Rows of a leaf.
LEAF = 256


class BallTree(Index):
    """Balls around halves of halves of the shard's rows; a leaf is a stretch of rows.

    No row of a ball has a higher inner product with a query than the centre's plus the
    ball's radius times the query's length.
    """

    @staticmethod
    def arrange(vec: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, dict, dict]:
        order, nodes, centres = np.arange(len(vec)), [], []
        open_ = [(0, len(vec), -1, 0)]
        real = vec.astype(np.float64)
        while open_:
            lo, hi, parent, side = open_.pop()
            here = real[order[lo:hi]]
            centre = here.mean(axis=0)
            away = ((here - centre) ** 2).sum(axis=1)
            if parent >= 0:
                nodes[parent][2 + side] = len(nodes)
            nodes.append([lo, hi, -1, -1])
            centres.append(np.append(centre, np.sqrt(away.max())))
            if hi - lo > LEAF:
                one = here[away.argmax()]
                other = here[((here - one) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(here @ (other - one), half)]
                open_ += [(lo, lo + half, len(nodes) - 1, 0), (lo + half, hi, len(nodes) - 1, 1)]
        return order, {}, {"nodes": np.array(nodes), "balls": np.array(centres)}

    def probe(self, block: Block) -> None:
        """Each query's most promising leaf, and then nodes in the order of their bounds; what is found raises the score to reach."""
        nodes, balls = self.head["nodes"], self.head["balls"]
        asked = block.vec.astype(np.float64)
        bounds = asked @ balls[:, :-1].T + np.sqrt((asked**2).sum(axis=1))[:, None] * balls[:, -1]
        bounds += 1 + 1e-9 * np.abs(bounds)  # more than sums of doubles are off

        def look(node: int, going: np.ndarray) -> None:
            part = slice(nodes[node, 0], nodes[node, 1])
            scores = products(block.vec[going], self.rows["vec"][part])
            ask, row = np.nonzero(scores >= block.reach()[going, None])
            block.offer(going[ask], row + part.start, scores[ask, row])
            bounds[going, node] = -np.inf  # not again

        leaves = np.flatnonzero(nodes[:, 2] < 0)
        start = leaves[bounds[:, leaves].argmax(axis=1)]
        for leaf in np.unique(start):
            look(leaf, np.flatnonzero(start == leaf))
        heap = [(-bounds[:, 0].max(), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            going = np.flatnonzero(bounds[:, node] >= block.reach())
            if len(going) and nodes[node, 2] < 0:
                look(node, going)
            elif len(going):
                for child in nodes[node, 2:]:
                    heapq.heappush(heap, (-bounds[going, child].max(), child))


def top_k(df: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, shard_rows: int = vectors.SHARD_ROWS) -> DataFrame:
    """query_id, rank, id (as ``vec_id``) and score: the ``k`` rows with the highest inner product for each row that meets ``queries``.

    Components count as floor(``scale`` times x); scores are whole numbers and have to fit in
    a long.  Ties go to the smaller id; rows without an id are found last among ties and ask
    nothing.  A query meets no row with its own id, so that none of its repetitions is found;
    a repeated query asks once, rows of one id with different vectors ask one by one; repeated
    rows are found as often as they are there.  Rows whose vector is null, or has a component
    that is null or not finite, take no part; vectors meet those of their own length, however
    long, and empty ones score 0.  Further columns have no influence; an empty table gives no
    rows.
    """
    rows = vectors.whole_numbers(df, queries, id, vector, scale)
    asks = vectors.questions(rows).withColumn("floors", F.array(F.lit(LOW))).withColumn("caps", F.array(F.lit(HIGH)))
    found = vectors.search(vectors.build(rows, BallTree, shard_rows), asks, BallTree, k)
    names = asks.select("q", F.col("id").alias("query_id"))
    return found.join(names, "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
