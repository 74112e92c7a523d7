"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine verification and connected components.

Equal vectors collapse to one row with a weight. Every distinct vector gets a code of `bits` signs in each of several
tables; vectors that share a code are compared in double precision. `bits` follows the logarithm of the number of
vectors, and the tables are as many as it takes to meet a pair exactly at the threshold with probability `recall`.

A pair met in several tables counts in the first of them only, so links are counted without listing pairs. A bucket
of more than `block` vectors is dealt to tasks as pairs of blocks. Each block gives link counts and a spanning forest
of its links, at most one edge a vector.

Cases: vectors that are null, empty, all zero or hold null or non-finite components, and rows without id, link with
nothing (component: their own id); finite components may be of any size; vectors of different length link with nothing;
rows of one id are one node for components, whatever their vectors; equal vectors link with each other; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import around, key_runs, pieces, prepare, released, scratch, write_table
from .components import connected_components

SEED = 20240


def _tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a code, number of tables."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 4)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p))


def _codes(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = 1 << np.arange(bits, dtype=np.int64)
        for batch in pieces(batches, 2000):
            vectors = batch.column("vec").to_pylist()
            out = np.zeros((len(vectors), tables), dtype=np.int64)
            raw: list[bytes] = [b""] * len(vectors)
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, bits * tables))
                own = np.flatnonzero(dims == d)
                x = np.array([vectors[i] for i in own], dtype=np.float64)
                x /= np.abs(x).max(axis=1)[:, None]  # squares of the rest neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1)[:, None]
                for i, unit in zip(own.tolist(), x, strict=True):
                    raw[i] = unit.astype("<f8").tobytes()
                out[own] = ((x @ planes[d]) > 0).reshape(len(own), tables, bits) @ place
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            keep = [batch.column(c) for c in ("gid", "id", "w", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(raw, pa.binary()), codes], ["gid", "id", "w", "h1", "h2", "raw", "codes"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the pairs (a, b) of 0..n-1 connect."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _links(threshold: float, at_once: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, ["t", "code", "bi", "bj", "dim"]):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            t_of, bi, bj, own, gid, ids, w = (table.column(c).to_numpy() for c in ("t", "bi", "bj", "own", "gid", "id", "w"))
            raw, codes = table.column("raw"), table.column("codes").combine_chunks()
            codes = codes.flatten().to_numpy().reshape(table.num_rows, -1)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                x = np.frombuffer(b"".join(raw.slice(s, e - s).to_pylist()), "<f8").reshape(e - s, -1)
                t, c, ww = int(t_of[s]), codes[s:e], w[s:e]
                same = bi[s] == bj[s]
                left = np.arange(e - s) if same else np.flatnonzero(own[s:e] == bi[s])
                right = left if same else np.flatnonzero(own[s:e] == bj[s])
                links, pa_, pb_ = np.zeros(e - s, dtype=np.int64), [], []
                for k in range(0, len(left), at_once):
                    i, j = np.nonzero(x[left[k : k + at_once]] @ x[right].T >= threshold)
                    i, j = left[i + k], right[j]
                    if same:
                        i, j = i[i < j], j[i < j]
                    if t and len(i):
                        seen = np.zeros(len(i), dtype=bool)
                        for u in range(t):
                            seen |= c[i, u] == c[j, u]
                        i, j = i[~seen], j[~seen]
                    np.add.at(links, i, ww[j])
                    np.add.at(links, j, ww[i])
                    pa_.append(i)
                    pb_.append(j)
                if links.any():
                    node, root = _forest(np.concatenate(pa_), np.concatenate(pb_), e - s)
                    to = ids[s:e].copy()
                    to[node] = ids[s:e][root]
                    hit = np.flatnonzero(links)
                    out.append((gid[s:e][hit], ids[s:e][hit], to[hit], links[hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], ["gid", "a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.998, block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every row of vectors."""
    prepare(vectors.sparkSession)
    outer = around()
    with scratch(vectors.sparkSession):
        found = write_table(_linked(vectors, threshold, recall, block, id_col, vec_col), "linked", outer)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", "kept")


def _linked(vectors: DataFrame, threshold: float, recall: float, block: int, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    rows = rows.select("id", F.when(sound, F.col("vec")).alias("vec"))
    h1 = F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("h1")
    h2 = F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(2), "vec")).alias("h2")
    groups = rows.filter(F.col("vec").isNotNull()).groupBy(h1, h2).agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("vec").alias("vec"))
    groups = write_table(groups.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    bits, tables = _tables(groups.count(), threshold, recall)
    coded = write_table(groups.mapInArrow(released(_codes(bits, tables)), "gid long, id long, w long, h1 long, h2 long, raw binary, codes array<long>"), "codes")
    dim = F.octet_length("raw").alias("dim")
    placed = coded.select("gid", dim, F.posexplode("codes").alias("t", "code"))
    full = placed.groupBy("t", "code", "dim").agg(F.count("*").alias("n")).filter("n > 1")
    full = full.select("t", "code", "dim", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = placed.join(full, ["t", "code", "dim"])
    own = F.pmod(F.xxhash64("gid", "t"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("gid", "t", "code", "dim", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    placed = placed.join(coded.select("gid", "id", "w", "raw", "codes"), "gid")
    keys = ["t", "code", "bi", "bj", "dim"]
    placed = placed.repartition(*keys).sortWithinPartitions(*keys)
    found = write_table(placed.mapInArrow(released(_links(threshold)), "gid long, a long, b long, links long"), "links")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    # rows of one id are one node: its groups are tied to the first of them
    of_id = rows.filter(F.col("vec").isNotNull()).select(F.col("id").alias("own"), h1, h2).join(groups.select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"]).select("own", "b").distinct()
    firsts = of_id.groupBy("own").agg(F.min("b").alias("a"), F.max("b").alias("high")).filter("a < high")
    tied = firsts.join(of_id, "own").select("a", "b").filter("a < b")
    parts = connected_components(found.select("a", "b").unionByName(tied))
    info = groups.select("gid", "id", "w", "h1", "h2").join(links, "gid", "left")
    info = info.join(parts.withColumnRenamed("node", "id"), "id", "left")
    info = info.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", h1, h2).join(info, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


#: The same for the test tables, by comparing all pairs.
SQL = r"""
WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
rows AS (SELECT r, vec_id, CASE WHEN vec_id IS NOT NULL AND len(v) = len(list_filter(v, lambda x: isfinite(x))) AND len(list_filter(v, lambda x: x <> 0)) > 0 THEN v END AS v FROM given),
sound AS (SELECT * FROM rows WHERE v IS NOT NULL),
links AS (SELECT a.r AS a, b.r AS b, a.vec_id AS ia, b.vec_id AS ib FROM sound a JOIN sound b ON a.r < b.r WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.95),
ends AS (SELECT a AS r, ia AS x, ib AS y FROM links UNION ALL SELECT b, ib, ia FROM links),
n AS (SELECT r, count(*) AS n_links FROM ends GROUP BY r),
edges AS (SELECT DISTINCT x, y FROM ends),
roots AS (SELECT x FROM edges GROUP BY x HAVING min(y) > x),
reach AS (SELECT x AS root, x AS node FROM roots UNION SELECT root, y FROM reach JOIN edges ON node = x),
part AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM rows LEFT JOIN n USING (r) LEFT JOIN part ON node = vec_id
"""
