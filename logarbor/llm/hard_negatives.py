"""Hard negatives by angular triangle filtering: stored angles bound scores, only open ones are computed.

Components become integers, floor(scale * x). Each row stores its norm and its angles to a
few reference directions. By the triangle inequality of angles, the angle of rows a and x
lies between the largest |angle(a, r) - angle(x, r)| and the least angle(a, r) + angle(x, r)
(or the full turn less that); the cosines of both ends times both norms bound the integer
score. Bounds are widened by more than the rounding of floats, so they never cut a score off.

1. Positives: an anchor's best ``positives`` other rows of its label. In a block of rows an
   anchor scores the rows of highest upper bound first, then those whose upper bound reaches
   the k-th best score so far.
2. Each positive opens a window [low * score, high * score]. In a block, an anchor scores
   only the rows of other labels whose bounds overlap one of its windows, and keeps the best
   ``negatives`` of each window.
3. Both times a ranked merge over the blocks gives the answer.

Every block of rows meets every block of anchors; reference directions are fitted on a
bounded sample and only decide how much is scored. Blocks are dealt by hash, so labels or
equal vectors of any frequency are spread.

Rows take no part if the id, the label or the vector is null, or a component is null or not
finite. Rows equal in id, label and vector are one row; rows of one id that differ are rows
of their own, as anchors too. Vectors of different lengths meet
on the components both have; an empty or zero vector scores zero. Integer scores beyond the
range of a long wrap. Ties go to the smaller vec_id. A positive of negative score opens an
empty window. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logarbor.llm.tools import written

SCALE = 256
REFERENCES = 16
SAMPLE_ROWS = 1024         # rows that the reference directions are fitted on
BLOCK_ROWS = 4096          # rows of a block, about
ANCHOR_ROWS = 512          # anchors of a block, about
FLOAT_EXACT = 2.0**52      # products whose sums stay below are exact in doubles
ANGLE_SLACK = 1e-6         # the arc cosine of a rounded cosine is off by some 1e-8 at most
SCORE_SLACK = 1e-9         # of the product of the norms


# ---------------------------------------------------------------- rows with stored angles
def _matrix(vectors, width: int | None = None) -> np.ndarray:
    """Integer vectors as rows, padded with zeros."""
    sizes = [len(v) for v in vectors]
    out = np.zeros((len(vectors), max(sizes, default=0) if width is None else width), np.int64)
    for k, v in enumerate(vectors):
        out[k, :sizes[k]] = v
    return out


def reference_directions(sample: list, n: int = REFERENCES) -> np.ndarray:
    """Unit vectors of the sample far from each other: each next one has the largest least angle to the others' lines."""
    rows = _matrix(sample).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1)
    rows = rows[norms > 0] / norms[norms > 0][:, None]
    if not len(rows):
        return np.zeros((0, rows.shape[1]))
    chosen = [0]
    near = np.abs(rows @ rows[0])
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, np.abs(rows @ rows[chosen[-1]]))
    return rows[chosen]


def angles_to(rows: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the reference directions (components that one side lacks count as zero)."""
    x = rows.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    width = min(x.shape[1], references.shape[1])
    cosines = x[:, :width] @ references[:, :width].T / np.where(norms > 0, norms, 1.0)[:, None]
    return norms, np.arccos(np.clip(cosines, -1.0, 1.0))


def score_bounds(a_norms: np.ndarray, a_angles: np.ndarray, norms: np.ndarray,
                 angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer scores that the stored angles allow, anchors by rows."""
    shape = (len(a_norms), len(norms))
    least, most = np.zeros(shape), np.full(shape, np.pi)
    for r in range(a_angles.shape[1]):
        a, x = a_angles[:, r][:, None], angles[:, r][None, :]
        np.maximum(least, np.abs(a - x), out=least)
        both = a + x
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    product = a_norms[:, None] * norms[None, :]
    slack = product * SCORE_SLACK + 1.0
    low = np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) * product - slack
    high = np.cos(np.maximum(least - ANGLE_SLACK, 0.0)) * product + slack
    return low, high


class Side:
    """A block of rows or anchors as arrays, ordered by id."""

    def __init__(self, t: pa.Table, references: np.ndarray) -> None:
        t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.ids, self.rows, self.labels = (t.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        self.x = _matrix([v.values.to_numpy() for v in t.column("v")])
        self.norms, self.angles = angles_to(self.x, references)
        self.table = t


def exact_scores(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products on the components both sides have."""
    width = min(len(anchor), rows.shape[1])
    a, x = anchor[:width], rows[:, :width]
    if width * float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) < FLOAT_EXACT:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return x @ a


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def cell_positives(anchors: Side, rows: Side, k: int) -> list[tuple]:
    """(anchor row, anchor_id, vec_id, score): best rows of the anchor's label, others than itself."""
    out = []
    _, high = score_bounds(anchors.norms, anchors.angles, rows.norms, rows.angles)
    for i, row in enumerate(anchors.rows):
        at = np.flatnonzero((rows.labels == anchors.labels[i]) & ((rows.rows != row) | (rows.ids != anchors.ids[i])))
        if len(at) > 4 * k:  # the most promising rows first, then all that could still reach the k-th of them
            tried = at[np.argpartition(-high[i, at], 2 * k)[:2 * k]]
            kth = np.sort(exact_scores(anchors.x[i], rows.x[tried]))[-k]
            at = at[high[i, at] >= kth]
        scores = exact_scores(anchors.x[i], rows.x[at])
        out += [(int(row), int(anchors.ids[i]), int(rows.ids[at[b]]), int(scores[b])) for b in best(scores, rows.ids[at], k)]
    return out


def cell_negatives(anchors: Side, rows: Side, k: int, low: int, high: int) -> list[tuple]:
    """(anchor row, anchor_id, positive's rank, vec_id, score): best rows of other labels in each positive's window, in per cent."""
    out = []
    least, most = score_bounds(anchors.norms, anchors.angles, rows.norms, rows.angles)
    opened = [w.as_py() for w in anchors.table.column("windows")]
    for i, row in enumerate(anchors.rows):
        windows = [(w["rank"], w["score"]) for w in opened[i] if low * w["score"] <= high * w["score"]]
        overlap = np.zeros(len(rows.ids), bool)
        for _, s in windows:
            overlap |= (100 * most[i] >= low * float(s)) & (100 * least[i] <= high * float(s))
        at = np.flatnonzero(overlap & (rows.labels != anchors.labels[i]))
        if not len(at):
            continue
        scores = exact_scores(anchors.x[i], rows.x[at])
        for rank, s in windows:
            exact = scores.astype(object) if np.abs(scores).max() > 1 << 55 else scores  # 100 times it must fit
            inside = np.flatnonzero((100 * exact >= low * s) & (100 * exact <= high * s))
            for b in best(scores[inside], rows.ids[at[inside]], k):
                out.append((int(row), int(anchors.ids[i]), rank, int(rows.ids[at[inside[b]]]), int(scores[inside[b]])))
    return out


# ---------------------------------------------------------------- the table
def _cells(rows: DataFrame, anchors: DataFrame, n: int, asked: int, block_rows: int, anchor_rows: int):
    """Rows and anchors with (part, block): every block of one side meets every block of the other."""
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-asked // anchor_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.col("row"), F.lit(m)).cast("int")
    left = anchors.withColumn("part", deal(parts)).withColumn("block", every(blocks))
    right = rows.withColumn("block", deal(blocks)).withColumn("part", every(parts))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, low: int = 80,
                   high: int = 100, references: int = REFERENCES, block_rows: int = BLOCK_ROWS,
                   anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` holds vec_id, label and v as from ``labelled_vectors``; ``low`` and ``high`` are per cent of the
    positive's score.
    """
    rows = written(vectors.select("vec_id", "label", "v").distinct()
                   .withColumn("row", F.xxhash64("vec_id", "label", "v")))
    n, asked = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    sample = [r[0] for r in rows.orderBy(F.xxhash64("row"), "row").select("v").limit(SAMPLE_ROWS).collect()]
    towards = reference_directions(sample, references)

    def find(a: pa.Table, x: pa.Table) -> pa.Table:
        found = cell_positives(Side(a, towards), Side(x, towards), positives) if len(a) and len(x) else []
        return _table(found, ("row", "anchor_id", "positive_id", "positive_score"))

    def mine(a: pa.Table, x: pa.Table) -> pa.Table:
        found = cell_negatives(Side(a, towards), Side(x, towards), negatives, low, high) if len(a) and len(x) else []
        return _table(found, ("row", "anchor_id", "positive", "negative_id", "negative_score"))

    # columns of their own, as both sides of a cogroup read one table
    anchors = rows.where(is_anchor).select(*(F.col(c).alias(c) for c in rows.columns))
    near = (_cells(rows, anchors, n, asked, block_rows, anchor_rows)
            .applyInArrow(find, "row bigint, anchor_id bigint, positive_id bigint, positive_score bigint"))
    order = Window.partitionBy("row", "anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = written(near.withColumn("positive", F.row_number().over(order).cast("bigint")).where(F.col("positive") <= positives))
    windows = near.groupBy("row", F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(
        F.col("positive").alias("rank"), F.col("positive_score").alias("score"))).alias("windows"))
    found = (_cells(rows, anchors.join(windows, ["row", "vec_id"]), n, asked, block_rows, anchor_rows)
             .applyInArrow(mine, "row bigint, anchor_id bigint, positive bigint, negative_id bigint, negative_score bigint"))
    order = Window.partitionBy("row", "anchor_id", "positive").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(near, ["row", "anchor_id", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(embeddings: DataFrame, label: Column, *, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, with components floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return (embeddings.where(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & finite)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                    F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v")))
