"""Vector code compression: product codebooks by Lloyd's rounds that look only at entries that moved.

Vectors of integers are cut into parts; each part position has its codebook. A round assigns every part to its nearest entry
and moves each entry to the mean of its parts. A part's assigned entry and exact distance are stored with it. In the next
round a part whose entry did not move compares that stored distance with the entries that did move alone, as all others
are where they were and lost against it before; a part whose entry moved is compared with the whole codebook. Equal
distances go to the lower index either way, so codes are those of plain Lloyd rounds.

Each round reads and writes the table once, without a shuffle of vectors: tasks emit what their reassigned parts add to
and take from entries, and only these sums, of the codebooks' size, meet. Codebooks go to every task; their size is
entries x entries of a vector, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import stage
from bindery.llm.integers import lists, matrix, scaled, sums

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task compares at once.
BLOCK = 4096


def distances(x: np.ndarray, book: np.ndarray, small: bool) -> np.ndarray:
    """Exact squared distances (rows, entries); ``small`` says that all of their terms are integers below 2**53."""
    if small:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - book[None, :, k]) ** 2
    return out


def assign(x: np.ndarray, book: np.ndarray, small: bool, code: np.ndarray | None = None, dist: np.ndarray | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries and their distances, lower index first; with the last round's ``code`` and ``dist``, and which entries
    have ``moved`` since, parts whose entry stayed compare with moved entries alone."""
    if code is None:
        all_of = distances(x, book, small)
        code = all_of.argmin(1)
        return code.astype(np.int32), all_of[np.arange(len(x)), code].astype(np.int64)
    code, dist = code.copy(), dist.copy()
    stale = moved[code]
    if stale.any():
        code[stale], dist[stale] = assign(x[stale], book, small)
    rivals, fixed = np.flatnonzero(moved), np.flatnonzero(~stale)
    if len(rivals) and len(fixed):
        at, near = assign(x[fixed], book[rivals], small)
        at = rivals[at]
        better = (near < dist[fixed]) | ((near == dist[fixed]) & (at < code[fixed]))
        code[fixed[better]], dist[fixed[better]] = at[better], near[better]
    return code, dist


def _round(books: np.ndarray, moved: np.ndarray | None, small: bool):
    """(id, label, x, code, dist) with new codes, then rows (at, value) of changes to counts and sums of entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, entries, width + 1), np.int64)
        names, label = None, None
        for whole in batches:
            for batch in (whole.slice(s, BLOCK) for s in range(0, whole.num_rows, BLOCK)):
                names, label = batch.schema.names, batch.schema.field("label").type
                x = matrix(batch.column(2), parts * width).reshape(-1, parts, width)
                old = None if moved is None else (matrix(batch.column(3), parts), matrix(batch.column(4), parts))
                code, dist = np.empty((len(x), parts), np.int32), np.empty((len(x), parts), np.int64)
                for p in range(parts):
                    before = () if old is None else (old[0][:, p], old[1][:, p], moved[p])
                    code[:, p], dist[:, p] = assign(x[:, p], books[p], small, *before)
                    new = slice(None) if old is None else code[:, p] != old[0][:, p]
                    item = np.concatenate([np.ones((len(x), 1), np.int64), x[:, p]], axis=1)[new]
                    np.add.at(change[p], code[new, p], item)
                    if old is not None:
                        np.subtract.at(change[p], old[0][new, p], item)
                none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(code), lists(dist), *none], [*names[:3], "code", "dist", "at", "value"])
        at = np.flatnonzero(change)
        if len(at):
            none = [pa.nulls(len(at), t) for t in (pa.int64(), label, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(at.astype(np.int32)), pa.array(change.ravel()[at])], [*names[:3], "code", "dist", "at", "value"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code array<int>, dist array<long>: one of each a part) and codebooks (parts, entries, entries of a part).

    An entry ``c`` of a vector counts as ``floor(scale * c)``. Codebooks start as the vectors of the ``entries`` smallest ids
    (fewer rows: as many; equal ids by vector, null ids last). Vectors that are null, empty or hold null or non-finite entries
    have no row; an empty table gives no rows and empty codebooks; repeated rows stay, with equal codes. Vectors of several
    lengths, of a length that ``parts`` doesn't divide, or so large that a squared distance leaves 64 bits are errors.
    """
    found = scaled(vectors, id_col, label_col, vector_col, scale)
    width, rest = divmod(found.dim, parts)
    if rest:
        raise ValueError(f"{found.dim} entries do not make {parts} equal parts")
    bound = width * (2 * found.most) ** 2
    if bound >= 1 << 63:
        raise ValueError("squared distances would leave 64 bits")
    first = found.rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    label = found.rows.schema["label"].dataType.simpleString()
    schema = f"id long, label {label}, x array<bigint>, code array<int>, dist array<bigint>, at int, value bigint"
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("code", "array<int>"), ("dist", "array<bigint>"))]
    now, moved, total = found.rows.select("id", "label", "x", *empty), None, np.zeros(books.size + books.shape[0] * books.shape[1], np.int64)
    for number in range(rounds + 1):
        done = stage(now.mapInArrow(_round(books, moved, bound < 1 << 53), schema), f"codes-{number}")
        now = done.where("at is null").select("id", "label", "x", "code", "dist")
        if number == rounds:
            break
        total += sums(done.where("at is not null").select("at", "value"), len(total))
        held = total.reshape(*books.shape[:2], width + 1)
        count = held[:, :, :1]
        new = np.where(count > 0, held[:, :, 1:] // np.maximum(count, 1), books)
        moved, books = (new != books).any(2), new
    return now.select("id", "label", "code", "dist"), books


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = coded.select("id", "label", code.alias("code"), F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    # written, so that a label that fills a third of the table meets its one sum straight from two exchanges, or a broadcast
    of_label = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "l")
    both = rows.join(of_label, F.col("label").eqNullSafe(F.col("l")), "left")
    return both.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    out = [
        f"k as materialized (select vec_id, label, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) as x from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)",
        f"p as materialized (select vec_id, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] as y from k, (select unnest(range({PARTS})) as part))",
        f"c0 as materialized (select part, n as entry, y as c from (select part, y, row_number() over (partition by part order by vec_id) - 1 as n from p) where n < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        near = "cast(list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
        out.append(f"a{r} as materialized (select vec_id, part, any_value(y) as y, min(struct_pack(d := {near}, e := entry)) as best from p join c{r} using (part) group by vec_id, part)")
        if r < ROUNDS:
            out.append(f"u{r} as (select part, entry, i, sum(v) as s, count(*) as n from (select part, best.e as entry, unnest(y) as v, generate_subscripts(y, 1) as i from a{r}) group by all)")
            out.append(f"m{r} as (select part, entry, list(cast((s - (s % n + n) % n) // n as bigint) order by i) as c from u{r} group by all)")
            out.append(f"c{r + 1} as materialized (select part, entry, coalesce(m.c, o.c) as c from c{r} o left join m{r} m using (part, entry))")
    out += [
        f"f as (select vec_id, string_agg(printf('%02x', best.e), '' order by part) as code, cast(sum(best.d) as bigint) as error from a{ROUNDS} group by vec_id)",
        "t as (select label, cast(sum(error) as bigint) as label_error from f join k using (vec_id) group by label)",
        f"b as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from c{ROUNDS})",
    ]
    return "with " + ",\n ".join(out) + "\nselect vec_id, code, error, label_error, codebooks_sha256 from f join k using (vec_id) join t on t.label is not distinct from k.label, b"


OP11_SQL = _sql()
