"""Near-duplicate vectors by an inverted multi-index.

A unit vector's two halves are quantised by codebooks of their own, so the cells form a product grid.  A vector visits
cells in order of how far they are from it, by the multi-sequence traversal of the two sorted lists of codewords.  How
far a cell can be and still hold a near duplicate is known: a half y within d of the half x lies in codeword j's region
only if x lies within d of the plane between j and x's own codeword.  So with a target recall of 1 the traversal ends where
the squares of these two distances exceed the squared radius, whatever the vectors and the grid are like, and no link is
missed.  With a lower target it ends sooner: where the share of the links of some probe vectors, which are looked for among
all vectors first, is reached.  What the traversal has found is verified.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, vectors, written
from spindrift.llm.components import components, forest

#: Vectors of a label in a cell, about: the grid grows with the table, up to the most codewords of a half.  A visit costs
#: as much as some hundreds of comparisons, so cells are large.
CELL_ROWS = 512
MOST_CODEWORDS = 512
#: Vectors whose links are counted to measure how far a traversal must go, and links of each that one task keeps.
PROBES = 256
PROBE_LINKS = 64
#: With fewer links of probes than this the traversal goes on to the end.
LEAST_LINKS = 200
#: Vectors that the codebooks are fitted on (those of smallest hash).
FIT_ROWS = 16384
FIT_ROUNDS = 8
ASSIGN_ROWS = 1024
#: Vectors that are compared at a time, and those of a cell, its own and visiting, that one task holds of a part.
BLOCK = 1024
PART = 8192


def fit_codebook(points: np.ndarray, words: int, seed: int) -> np.ndarray:
    """k-means from seeded points; empty codewords keep their place."""
    points = np.unique(points, axis=0)
    if len(points) == 0:
        return np.zeros((1, points.shape[1]))
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:words]]
    for _ in range(FIT_ROUNDS):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squares(points, centres).argmin(1)


def plane_distances(points: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How far each point is from each codeword's region at least: 0 for its own codeword."""
    far = squares(points, centres)
    apart = np.sqrt(squares(centres, centres))[own]
    gap = far - far[np.arange(len(points)), own][:, None]
    # what rounding can add to the gap is left out
    return np.where(apart > 0, np.maximum(gap - 1e-12, 0) / np.maximum(2 * apart, 1e-300), 0)


def visit(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: pairs of codewords by ascending first[i]**2 + second[j]**2, up to ``limit``."""
    by1, by2 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by1] ** 2, second[by2] ** 2
    out, heap, seen = [], [(float(a[0] + b[0]), 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            break
        out.append((int(by1[i]), int(by2[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen and a[x] + b[y] <= limit:
                seen.add((x, y))
                heapq.heappush(heap, (float(a[x] + b[y]), x, y))
    return out


def usable(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    """Rows that can link, and their unit vectors in double precision."""
    rows, units = [], []
    for row, v in enumerate(vectors(batch["embedding"])):
        if v is not None and len(v) and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top
            rows.append(row)
            units.append(v / np.sqrt(v @ v))
    return rows, units


Books = dict[int, tuple[np.ndarray, np.ndarray]]


def homes_and_distances(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], int]:
    """Own codewords of both halves, how far all codewords' regions are at least, and the second book's size."""
    length = x.shape[1]
    first, second = books.get(length) or (np.zeros((1, length // 2)), np.zeros((1, length - length // 2)))
    halves = x[:, : length // 2], x[:, length // 2 :]
    own = nearest(halves[0], first), nearest(halves[1], second)
    return *own, (plane_distances(halves[0], first, own[0]), plane_distances(halves[1], second, own[1])), len(second)


def _assign(shared, radius: float, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (reach * radius) ** 2 * (1 + 1e-9)
        for whole in batches:
            for start in range(0, whole.num_rows, ASSIGN_ROWS):
                batch = whole.slice(start, ASSIGN_ROWS)
                rows, units = usable(batch)
                by_length: dict[int, list[int]] = {}
                for at, u in enumerate(units):
                    by_length.setdefault(len(u), []).append(at)
                taken: list[int] = []
                cells: list[int] = []
                homes: list[bool] = []
                for length, ats in by_length.items():
                    own1, own2, far, size = homes_and_distances(np.array([units[at] for at in ats]), shared.value)
                    for k, at in enumerate(ats):
                        home = int(own1[k]) * size + int(own2[k])
                        found = {i * size + j for i, j in visit(far[0][k], far[1][k], limit)} | {home}
                        found = sorted(c for c in found if c >= home)  # the other way round the partner visits this cell
                        taken += [rows[at]] * len(found)
                        cells += [c + (length << 32) for c in found]
                        homes += [c == home for c in found]
                out = batch.take(pa.array(taken, pa.int64()))
                yield pa.record_batch({**{k: out[k] for k in ("label", "rep", "copies")}, "cell": pa.array(cells, pa.int64()), "home": pa.array(homes, pa.bool_()), "embedding": out["embedding"]})

    return run


def cost(x: np.ndarray, y: np.ndarray, books: Books) -> np.ndarray:
    """How far the traversal must go to find each pair of rows: from the one of the lower cell to the other's cell."""
    found = []
    at = np.arange(len(x))
    for a, b in ((x, y), (y, x)):
        i, j, far, size = homes_and_distances(a, books)
        p, q, *_ = homes_and_distances(b, books)
        found.append((i * size + j, np.sqrt(far[0][at, p] ** 2 + far[1][at, q] ** 2)))
    return np.where(found[0][0] <= found[1][0], found[0][1], found[1][1])


def _probed(shared, probes, least: float, radius: float):
    """Of each task and probe up to PROBE_LINKS links, with how many each stands for: (cost as a share of the radius, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = probes.value
        found: dict[int, list] = {}
        rng = np.random.default_rng(3)
        for batch in batches:
            rows, units = usable(batch)
            reps, labels = batch["rep"].to_numpy(), batch["label"].to_numpy()
            for length in {len(u) for u in units}:
                those = [(r, u) for r, u in zip(rows, units, strict=True) if len(u) == length]
                asked = [k for k, p in enumerate(own) if len(p[2]) == length]
                if not asked:
                    continue
                at, x = np.array([r for r, _ in those]), np.array([u for _, u in those])
                near = np.array([own[k][2] for k in asked]) @ x.T >= least
                near &= np.array([own[k][1] for k in asked])[:, None] == labels[at]
                near &= np.array([own[k][0] for k in asked])[:, None] != reps[at]
                for row in np.flatnonzero(near.any(1)):
                    held = found.setdefault(asked[row], [0, []])
                    for k in np.flatnonzero(near[row]):  # a seeded sample of bounded size
                        held[0] += 1
                        if len(held[1]) < PROBE_LINKS:
                            held[1].append(x[k])
                        elif (place := int(rng.integers(held[0]))) < PROBE_LINKS:
                            held[1][place] = x[k]
        for k, (n, partners) in found.items():
            y = np.array(partners)
            costs = cost(np.repeat(own[k][2][None, :], len(y), 0), y, shared.value) / radius
            yield pa.record_batch({"cost": pa.array(costs), "weight": pa.array(np.full(len(y), n / len(y)))})

    return run


def measured_reach(same: DataFrame, shared, least: float, radius: float, target: float) -> float:
    """The share of the radius up to which cells must be visited so that ``target`` of the links are found, one standard error
    and more on the safe side, from all links of PROBES vectors; 1 where these have too few links to tell."""
    ok = same.where("size(embedding) > 0").select("rep", "label", "embedding", F.lit(0).alias("copies"), F.xxhash64("rep", F.lit(1)).alias("h")).orderBy("h").limit(PROBES)
    probes = []
    for batch in ok.toArrow().to_batches():
        rows, units = usable(batch)
        probes += [(batch["rep"][r].as_py(), batch["label"][r].as_py(), u) for r, u in zip(rows, units, strict=True)]
    found = same.select("rep", "label", "embedding").mapInArrow(_probed(shared, same.sparkSession.sparkContext.broadcast(probes), least, radius), "cost double, weight double")
    # costs in steps of a thousandth, rounded up: rows of a bounded number
    steps = found.groupBy(F.ceil(F.col("cost") * 1000).cast("int").alias("step")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).orderBy("step").collect()
    total, n = sum(r.w for r in steps), sum(r.n for r in steps)
    if n < LEAST_LINKS:
        return 1.0
    wanted = min(1.0, target + 2 * (target * (1 - target) / n) ** 0.5) * total
    reached = 0.0
    for r in steps:
        reached += r.w
        if reached >= wanted * (1 - 1e-12):
            return min(1.0, r.step / 1000)
    return 1.0


def _spanning(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links of a block connect: labels spread over rows and columns until none changes."""
    top = max(near.shape) + sum(near.shape)
    of_row, of_column = np.arange(near.shape[0]), np.full(near.shape[1], top)
    while True:
        of_column = np.minimum(of_column, np.where(near, of_row[:, None], top).min(0))
        new = np.minimum(of_row, np.where(near, of_column[None, :], top).min(1))
        if (new == of_row).all():
            break
        of_row = new
    return [*((int(rows[i]), int(rows[k])) for i, k in enumerate(of_row.tolist()) if k != i), *((int(columns[j]), int(rows[k])) for j, k in enumerate(of_column.tolist()) if k < top)]


def _compare(least: float):
    """Two parts of a cell (or one with itself): its own vectors with each other and with its visitors, in steps of BLOCK."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("home", "descending"), ("rep", "ascending")])
        x = np.array([u for batch in table.select(["embedding"]).to_batches() for u in usable(batch)[1]])
        rep, copies, home, part = (table[k].to_numpy() for k in ("rep", "copies", "home", "part"))
        own, crossing = int(home.sum()), table["p"][0].as_py() != table["q"][0].as_py()
        links = np.zeros(len(rep), np.int64)
        edges: dict[int, int] = {}
        for s in range(0, own, BLOCK):
            for t in range(s, len(rep), BLOCK):
                near = x[s : min(own, s + BLOCK)] @ x[t : t + BLOCK].T >= least
                near &= np.arange(s, s + near.shape[0])[:, None] < np.arange(t, t + near.shape[1])
                if crossing:
                    near &= part[s : s + near.shape[0], None] != part[t : t + near.shape[1]]
                if near.any():
                    links[s : s + near.shape[0]] += near @ copies[t : t + near.shape[1]]
                    links[t : t + near.shape[1]] += copies[s : s + near.shape[0]] @ near
                    # the first link of each row and of each column, and the rows' labels, hold the block together
                    edges = forest([*edges.items(), *_spanning(near, rep[s : s + near.shape[0]], rep[t : t + near.shape[1]])])
        found = np.flatnonzero(links)
        low = np.array([edges.get(int(rep[k]), int(rep[k])) for k in found], np.int64)
        return pa.table({"rep": pa.array(rep[found]), "links": pa.array(links[found]), "low": pa.array(low)})

    return run


def link_vectors(rows: DataFrame, least: float = 0.98, target: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows`` (vec_id, embedding, label, anything more).

    Two rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least ``least``.  Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths; a null vec_id links with nothing and has component_id null and kept false.  Rows that
    repeat a vec_id count as links of each other if their vectors link.

    Links that are returned hold exactly.  With ``target`` 1 none is missed, whatever the grid.  With a lower one cells are
    visited as far as the links of PROBES vectors of the table say is needed for that recall (``measured_reach``): fewer
    visits for large tables of many dimensions, where the bound of the exact traversal leaves out little.

    Equal vectors of one label are compared once, with their number as weight.  What meets in a cell is dealt
    to parts of bounded size, and two parts give sums and a forest, never their pairs.  Codebooks are fitted on FIT_ROWS vectors.
    """
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType.simpleString()
    rows = rows.select("vec_id", "embedding", "label")
    valid = "label is not null and vec_id is not null and embedding is not null"
    same = rows.where(valid).withColumn("label", F.xxhash64(F.col("label").cast("string"))).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    same = written(same, "vectors")
    sample = same.where("size(embedding) > 0").select("embedding", F.lit(0).alias("label"), F.xxhash64("rep").alias("h"), "rep", "copies").orderBy("h").limit(FIT_ROWS).select("embedding").toArrow()
    books: Books = {}
    by_length: dict[int, list[np.ndarray]] = {}
    for batch in sample.to_batches():
        for u in usable(batch)[1]:
            by_length.setdefault(len(u), []).append(u)
    per_label = same.groupBy("label").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.lit(1.0))).first()[0]
    words = max(1, min(MOST_CODEWORDS, math.ceil((per_label / CELL_ROWS) ** 0.5)))
    for length, own in by_length.items():
        x = np.array(own)
        books[length] = fit_codebook(x[:, : length // 2], words, 1), fit_codebook(x[:, length // 2 :], words, 2)
    shared = spark.sparkContext.broadcast(books)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    reach = 1.0 if target >= 1 else measured_reach(same, shared, least, radius, target)
    visits = same.mapInArrow(_assign(shared, radius, reach), f"label long, rep long, copies long, cell long, home boolean, embedding {kind}")
    visits = written(visits, "visits")
    # what meets in a cell is dealt to parts of bounded size, and each part meets each
    parts = visits.groupBy("label", "cell").agg((F.floor((F.count("*") - 1) / PART) + 1).alias("parts"))
    dealt = visits.join(parts, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("label", "cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "rep", "copies", "home", "part", "embedding")
    found = written(dealt.groupBy("label", "cell", "p", "q").applyInArrow(_compare(least), "rep long, links long, low long"), "links")
    forget(visits)
    near = found.groupBy("rep").agg(F.sum("links").alias("links"))
    at = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    # usable vectors link with their equals
    unit_ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    same = same.join(near, "rep", "left").join(at.withColumnRenamed("node", "rep"), "rep", "left")
    same = same.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "rep", F.when(unit_ok, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).alias("n_links"), F.coalesce("component", "rep").alias("component"), unit_ok.alias("ok"))
    keyed = rows.withColumn("_h", F.xxhash64(F.col("label").cast("string")))
    out = keyed.join(same, (F.col("_h") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), "left")
    component = F.when(F.coalesce("ok", F.lit(False)), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
