"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on many random lines. Two vectors at the threshold are so close that their projections on a
line fall into one another's window with a known chance; the number of lines that must collide is set from that chance
for a wanted recall. The first lines also cut space into cells, so a vector meets only its own and adjacent cells; within
them the other projections are sorted, windows around each query are counted, and pairs with enough collisions are
verified by their cosine. Equal vectors are one node, large cells are dealt out as pairs of chunks. The more vectors a
label has, the more lines cut the cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import components, forest, stage

THRESHOLD = 0.98
#: Lines; half-width of a window and of a cell, as multiples of the distance at the threshold.
LINES, WINDOW, CELL = 16, 2.0, 3.2
#: Wanted recall of the collision count at the threshold itself; closer pairs have more.
RECALL = 0.995
#: Vectors of a side that one comparison holds.
CHUNK = 1024
#: Lines that are counted for all pairs of a comparison, before few pairs are left.
DENSE = 8


def lines_for(dim: int) -> np.ndarray:
    """(dim, LINES) directions, the same in every task."""
    return np.random.default_rng(dim).normal(size=(dim, LINES))


def needed(recall: float = RECALL, lines: int = LINES, window: float = WINDOW) -> int:
    """The largest count of collisions that pairs at the threshold reach with the wanted chance."""
    p = erf(window / sqrt(2))
    reach = 0.0
    for n in range(lines, -1, -1):
        reach += comb(lines, n) * p**n * (1 - p) ** (lines - n)
        if reach >= recall:
            return n
    return 0


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x**2).sum(1))[:, None]


def cell_lines(n: int) -> int:
    """Lines that cut cells for labels of ``n`` vectors: the number for which comparing and dealing out cost least together.

    With k lines a vector is dealt to (3**k + 1) / 2 + 1 cells, at about 2 microseconds each, and compared with all of the
    adjacent cells at about 10 nanoseconds a vector; a line's cells hold as many as 5.5 equally filled ones would.
    """
    cost = lambda k: 10 * n * (3**k + 1) / 2 / 5.5**k + 2000 * ((3**k + 1) / 2 + 1)
    return min(range(2, 7), key=cost)


def _cells(width: float, k: int):
    """Adds the cell on the first ``k`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy()
            at = np.zeros((len(sizes), k), np.int32)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                at[own] = np.floor(_unit(vectors.take(pa.array(own)), int(dim)) @ lines_for(int(dim))[:, :k] / width)
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], ["id", "label", "vector", "times", "cell"])

    return run


def candidates(q: np.ndarray, d: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, data row) of unit vectors that collide on ``least`` lines or more."""
    lines = lines_for(q.shape[1])
    pq, pd = q @ lines, d @ lines
    count = np.zeros((len(q), len(d)), np.int8)
    rows = np.arange(len(q))
    for k in range(DENSE):
        order = np.argsort(pd[:, k])
        line = pd[order, k]
        edge = np.zeros((len(q), len(d) + 1), np.int8)
        edge[rows, np.searchsorted(line, pq[:, k] - window, "left")] += 1
        edge[rows, np.searchsorted(line, pq[:, k] + window, "right")] -= 1
        count[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int8)
    i, j = np.nonzero(count >= least - (LINES - DENSE))
    n = count[i, j].astype(np.int64)
    for k in range(DENSE, LINES):
        n += np.abs(pq[i, k] - pd[j, k]) <= window
        ok = n >= least - (LINES - k - 1)
        i, j, n = i[ok], j[ok], n[ok]
    return i, j


def _compare(threshold: float, window: float, least: int):
    """Rows (unit, query, id, home, times, vector) sorted by unit to links: (0, id, number of linked vectors), (1, a, b)."""

    def unit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ask = rows.column("query").to_numpy()
        ids, home, times = (rows.column(c).to_numpy() for c in ("id", "home", "times"))
        dim = len(rows.column("vector")[0])
        x = _unit(rows.column("vector").combine_chunks(), dim)
        q, d = np.flatnonzero(ask), np.flatnonzero(~ask)
        a, b = [], []
        for s in range(0, len(q), CHUNK):
            for t in range(0, len(d), CHUNK):
                i, j = candidates(x[q[s : s + CHUNK]], x[d[t : t + CHUNK]], window, least)
                i, j = q[s + i], d[t + j]
                ok = ~home[j] | (ids[i] < ids[j])  # pairs within a cell come up twice
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                a.append(i[ok])
                b.append(j[ok])
        a, b = np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)])
        if len(a):
            who, at = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([times[b], times[a]])).astype(np.int64)
            u, v = forest(ids[a], ids[b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([0, 1], np.int8), [len(who), len(u)])), pa.array(np.concatenate([who, u])), pa.array(np.concatenate([n, v]))], ["kind", "a", "b"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            units = rest.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist()]
            for s, t in zip(cuts, cuts[1:], strict=False):
                yield from unit(rest.slice(s, t - s))
            rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield from unit(rest)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", lines: int | None = None) -> DataFrame:
    """Per row of ``vectors``: ``id_col``, n_links (other vectors with equal label and cosine >= ``threshold``), component_id, kept.

    Vectors that are null, zero or hold null or non-finite components, and those with a null label, link with nothing;
    neither do vectors of different lengths. Equal vectors link with each other. Rows with a null id are counted as links
    of others and carry links on, but are never the smallest id and not kept; a component of none but those has a null
    component_id. Recall of pairs is set by the window count (``RECALL``) and the cells, which ``lines`` projections cut
    (default: by the largest label); no pair below the threshold is linked. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    fit = F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & ~bad & (norm > 0), F.lit(False))
    # nodes have numbers of their own, fixed as the table is written, so that vectors whose ids are all null are nodes too
    nodes = stage(rows.where(fit).groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("times")).select(F.monotonically_increasing_id().alias("id"), "label", "vector", "times", "least"), "vectors")
    k = lines or cell_lines(nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    distance = sqrt(2 - 2 * threshold)
    kind = nodes.schema["label"].dataType.simpleString(), nodes.schema["vector"].dataType.simpleString()
    placed = nodes.drop("least").mapInArrow(_cells(CELL * distance, k), f"id long, label {kind[0]}, vector {kind[1]}, times long, cell array<int>")
    # a cell's queries meet the vectors of the cell and of half of the adjacent ones; the other half meet it
    here = (0,) * k
    near = [(True, here), *[(False, to) for to in product((-1, 0, 1), repeat=k) if to <= here]]
    steps = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(to == here).alias("home"), F.array(*map(F.lit, to)).alias("to")) for q, to in near])
    met = placed.withColumn("s", F.explode(steps)).select("id", "label", F.size("vector").alias("dim"), "vector", "times", F.zip_with("cell", "s.to", lambda a, b: a + b).alias("cell"), "s.query", "s.home")
    cell = ["label", "dim", "cell"]
    sizes = met.groupBy(*cell).agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("d")).where((F.col("q") > chunk) | (F.col("d") > chunk))
    large = stage(sizes.select(*cell, F.ceil(F.col("q") / chunk).cast("int").alias("nq"), F.ceil(F.col("d") / chunk).cast("int").alias("nd")), "large")
    dealt = met.join(large, cell, "left").withColumns({"nq": F.greatest(F.coalesce("nq", F.lit(1)), F.lit(1)), "nd": F.greatest(F.coalesce("nd", F.lit(1)), F.lit(1))})
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), F.col(n)).cast("int")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("nd")).otherwise(F.col("nq")) - 1)))
    i, j = F.when(F.col("query"), mine("nq")).otherwise(F.col("other")), F.when(F.col("query"), F.col("other")).otherwise(mine("nd"))
    units = dealt.select(F.xxhash64(*cell, i, j).alias("unit"), "dim", "query", "id", "home", "times", "vector")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = units.repartition(n, "unit").sortWithinPartitions("unit").drop("dim").mapInArrow(_compare(threshold, WINDOW * distance, needed()), "kind byte, a long, b long")
    links = stage(links, "links")
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    found = components(links.where("kind = 1").select("a", "b"))
    known = nodes.join(counts, nodes["id"] == counts["node"], "left").drop("node").join(found, nodes["id"] == found["node"], "left")
    known = stage(known.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least", F.col("root").alias("of")), "linked")
    roots = known.where("of is not null").groupBy("of").agg(F.min("least").alias("root"))
    alone = known.where("of is null").select("l", "v", "n_links", F.col("least").alias("root"))
    known = stage(known.join(roots, "of").select("l", "v", "n_links", "root").unionByName(alone), "known")
    out = rows.withColumn("fit", fit).join(known, F.col("fit") & (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
