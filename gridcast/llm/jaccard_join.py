"""Exact Jaccard self-join of documents on word shingles by a grouped prefix join, and its connected components.

A document becomes its set of distinct `shingle`-word windows, as 64-bit hashes; sets of equal 128-bit digest are one
node. All sets are put in one global order: hashes that many sets share (found exactly among the first five sixteenths of every set's
hashes) last, then by hash value. Two sets as similar as the threshold share one of their first floor(n/4)+1 hashes,
so only these prefixes meet, and a pair only where the hash stands early enough in both for the overlap that their
sizes ask for. Sets of equal prefix and size form a group, and a group has one posting per prefix hash.

Round one verifies, in every group, its members against its first and, in every posting list, groups against a
leader of their size class: at most as many pairs as postings, however large a list is. The leader is a group in
which the list's hash stands earliest: with shared hashes last, it has the fewest of its own, and so is the one most
others are near to. Of equals, one of LEADERS orders decides, picked by the list's hash: the many lists that a large
cluster shares give its members a few leaders to link with, not as many as lists. Components of the verified links
follow. Round two settles the rest: lists, and groups, whose sets still lie in different components. Every set outside
the component that most of a list's sets are in is compared with the list, blocks against blocks; lists that agree in
that component and in the smallest set outside of it are compared as one, so that the many lists of one passage don't
repeat each other's pairs. A link that neither round looks at joins sets of one component, so the components are those
of all links.

A list of a shared hash would pair all sets that are mostly made of some common passage. But a set with such a hash in
its prefix has all of its unshared hashes there, so two of them that have any unshared hash in common meet in that
one's list; in the shared hash's own list only pairs count that are similar enough by shared hashes alone. Sets that
are too far from the smallest one of the list for that leave it.

Before whole sets are compared, pairs pass an exact bound: every node has a bitmap of the parities of its hashes by
their low bits, and the bits in which two bitmaps differ are at most the hashes in which the sets differ.

Cases: a text of fewer words is one shingle of all its words; null and empty texts, and rows without id, link with
nothing; equal texts link; rows of one id are one document, whatever their texts, and in one component; an empty table
gives no rows; other columns aren't carried, except by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import around, key_runs, pieces, prepare, released, scratch, text_bytes, write_table
from .components import connected_components

#: Sets that share a hash for it to go last in the order, and how many such hashes workers are sent (8 bytes each).
#: Both only move work about: any order gives the same links.
HEAVY, MAX_HEAVY = 50, 250_000
#: Orders by which lists pick their leader; it only moves work between the rounds.
LEADERS = 8
#: Members of a merged list that are compared in one go; longer ones are dealt out as pairs of blocks.
BLOCK = 1024
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word windows; of all words where there are fewer."""
    words = text.lower().split()  # of bytes: A-Z only, white space of ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    acc = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : len(h) - k + 1 + j]) * ODD
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _digest(values: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes(), seed) - (1 << 63)


def parities(s: np.ndarray) -> bytes:
    """Bitmap of whether an odd number of hashes has given low bits; two to four bits a hash."""
    size = max(256, 2 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmap: bytes, size: int) -> bytes:
    """The bitmap by fewer low bits."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = (int.from_bytes(bitmap[:half], "little") ^ int.from_bytes(bitmap[half:], "little")).to_bytes(half, "little")
    return bitmap


def _possible(percent: int):
    """Pairs whose bitmaps differ in no more bits than similar sets may differ in hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            differ = np.zeros(len(total), dtype=np.int64)
            bits_a, bits_b = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
            sizes = np.minimum([len(x) for x in bits_a], [len(x) for x in bits_b]).astype(np.int64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join(_folded(bits[i], size) for i in own), np.uint8).reshape(len(own), -1) for bits in (bits_a, bits_b))
                differ[own] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(differ * (100 + percent) <= total * (100 - percent))
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _low(k: int):
    """First five sixteenths of every set, a quarter more than its prefix; equal sets of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            out = []
            for text in text_bytes(batch.column("text")):
                s = shingles(text, k)
                if len(s) and (own := _digest(s, 0)) not in seen:
                    seen.add(own)
                    out.append(s[: len(s) * 5 // 16 + 1])
            if out:
                values, counts = np.unique(np.concatenate(out), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "n"])

    return run


def _prefixes(k: int, heavy: np.ndarray):
    """Per document: id, set size, digest (of the set), how many of its hashes aren't shared, group (of prefix and size), the prefix once per group and task, the bitmap once per digest and task.

    Groups of equal 64-bit digest are taken for one: that compares more, and loses no link, as every member of a group
    that ends up in parts is compared in round two; what a task has seen is told by 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        nodes: set[tuple[int, int]] = set()
        for batch in pieces(batches):
            out = []
            for text, known in zip(text_bytes(batch.column("text")), batch.column("id").is_valid().to_pylist(), strict=True):
                s = shingles(text, k)
                if not len(s) or not known:
                    out.append((len(s), None, None, None, None, None, None))
                    continue
                late = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s if len(heavy) else np.zeros(len(s), dtype=bool)
                p = np.concatenate([s[~late], s[late]])[: len(s) // 4 + 1]
                node, group = (_digest(s, 0), _digest(s, 1)), (_digest(p, len(s)), _digest(p, -len(s) % (1 << 63)))
                out.append((len(s), *node, len(s) - int(late.sum()), group[0], None if group in seen else p.view(np.int64), None if node in nodes else parities(s)))
                nodes.add(node)
                seen.add(group)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", "n", "d1", "d2", "light", "grp", "prefix", "bits"])

    return run


def _sets(k: int):
    """node and set of documents whose node was asked for; a node of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            node, out = [], []
            wanted = zip(*(batch.column(c).to_pylist() for c in ("node", "d1", "d2")), strict=True)
            for text, (want, d1, d2) in zip(text_bytes(batch.column("text")), wanted, strict=True):
                if want in seen:
                    continue
                s = shingles(text, k)
                if len(s) and (_digest(s, 0), _digest(s, 1)) == (d1, d2):  # rows of one id may differ in text
                    seen.add(want)
                    node.append(want)
                    out.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["node", "set"])

    return run


def _lists(percent: int):
    """Posting lists of two groups or more: each posting with the leader of its list and size class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, ["h"]):
            h, n, g, place, light = (table.column(c).to_numpy() for c in ("h", "n", "grp", "place", "light"))
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (n[1:] != n[:-1])  # a group from several tasks
            # the smallest set of a list asks for the least overlap, and so for the longest prefix
            least_n = np.maximum(np.repeat(n[starts[:-1]], np.diff(starts)), -(-n * percent // 100))
            first &= place + -(-percent * (n + least_n) // (100 + percent)) <= n
            counts = np.add.reduceat(first.astype(np.int64), starts[:-1])
            many = np.repeat(counts > 1, np.diff(starts)) & first
            if not many.any():
                continue
            h, n, g, place, shared = h[many], n[many], g[many], place[many], (place >= light)[many]
            # within a class sizes are compatible, and ascending sizes keep a list's classes together
            kind = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])))
            rank = (g.view(np.uint64) ^ (h.view(np.uint64) % np.uint64(LEADERS) + np.uint64(1)) * ODD) * ODD
            rank = (rank >> np.uint64(32)) | (place.astype(np.uint64) << np.uint64(32))
            least = np.minimum.reduceat(rank, cut)
            runs = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(h))))
            lead = np.zeros(len(cut), dtype=np.int64)
            own = rank == least[runs]
            lead[runs[own]] = g[own]
            leader = lead[runs]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, shared, leader)], ["h", "grp", "shared", "leader"])

    return run


def _cross(percent: int, at_once: int = 256):
    """Pairs of a sought node (role 0) and any other of the same block, across components, that sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in key_runs(batches, ["main", "via", "ba", "bb"]):
            node, n, c, role = (table.column(k).to_numpy() for k in ("node", "n", "c", "role"))
            raw, out = table.column("bits").to_pylist(), []
            sizes = np.array([len(x) for x in raw])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for size in np.unique(sizes[s:e]).tolist():
                    left = s + np.flatnonzero((sizes[s:e] == size) & (role[s:e] == 0))
                    for other in (size // 2, size, size * 2):  # compatible sets have bitmaps of equal or next length
                        right = s + np.flatnonzero((sizes[s:e] == other) & (role[s:e] == 1))
                        if not len(left) or not len(right):
                            continue
                        x, y = (np.frombuffer(b"".join(_folded(raw[i], min(size, other)) for i in own), np.uint64).reshape(len(own), -1) for own in (left, right))
                        for k in range(0, len(left), at_once):
                            own = left[k : k + at_once]
                            fits = c[own, None] != c[right][None, :]
                            fits &= np.minimum(n[own, None], n[right][None, :]) * 100 >= percent * np.maximum(n[own, None], n[right][None, :])
                            i, j = np.nonzero(fits)
                            for m in range(0, len(i), 1 << 16):
                                i_, j_ = i[m : m + (1 << 16)], j[m : m + (1 << 16)]
                                differ = np.bitwise_count(x[k + i_] ^ y[j_]).sum(axis=1, dtype=np.int64)
                                keep = differ * (100 + percent) <= (n[own[i_]] + n[right[j_]]) * (100 - percent)
                                a, b = node[own[i_[keep]]], node[right[j_[keep]]]
                                out.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, linked of the distinct pairs of nodes (a, b) that pass the bitmaps, by the whole sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(_possible(percent)), "a long, b long")
    pairs = write_table(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = asked.join(nodes.select("node", "d1", "d2", "first_id"), "node")
    texts = docs.join(asked, F.col("id") == F.col("first_id")).select("node", "d1", "d2", "text")
    sets = write_table(texts.mapInArrow(released(_sets(k)), "node long, set array<long>"), "sets")
    sets = sets.dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    return write_table(both.select("a", "b", (F.col("common") * 100 >= percent * (F.col("sum") - F.col("common"))).alias("linked")), "verified")


def _candidates(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets in different components that share a list or group, and that sizes and bitmaps allow."""
    # a group that is still in parts is a list of its own: its lists may hold no other group
    parted = placed.groupBy("grp").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    held = lists.select("h", "grp", "shared").unionByName(parted.select(F.col("grp").alias("h"), "grp", F.lit(False).alias("shared")))
    held = held.withColumn("kind", F.col("shared").cast("int"))  # a hash and a group of one number are lists apart
    members = write_table(held.join(placed.select("node", "grp", "c", "n", "light"), "grp").select("h", "kind", "node", "c", "n", "light"), "members")
    keys = ["h", "kind"]
    mains = members.groupBy(*keys, "c").agg(F.count("*").alias("k"), F.min("n").alias("n")).groupBy(*keys)
    mains = mains.agg(F.max(F.struct("k", "c")).alias("most"), F.count("*").alias("parts"), F.min("n").alias("least")).filter("parts > 1")
    members = members.join(mains.select(*keys, F.col("most.c").alias("main"), "least"), keys)
    # by shared hashes alone a set is similar to others of at most this size
    reach = lambda other: (F.col("kind") == 0) | ((100 + percent) * (F.col("n") - F.col("light")) >= percent * (F.col("n") + F.col(other)))
    members = members.filter(reach("least"))
    outside = members.filter("c <> main").groupBy(*keys).agg(F.min("node").alias("via"), F.min("n").alias("least_outside"))
    near = members.join(outside, keys).filter((F.col("c") != F.col("main")) | reach("least_outside"))
    near = write_table(near.select("main", "via", "node", "c").distinct(), "near")
    lists_of = ["main", "via"]
    sought = F.count_if(F.col("c") != F.col("main"))
    blocks = near.groupBy(*lists_of).agg(F.ceil(sought / BLOCK).cast("int").alias("blocks_a"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks_b"))
    near = near.join(blocks, lists_of).withColumn("own", F.xxhash64("node", "main"))
    own = lambda k: F.array(F.pmod("own", F.col(k)).cast("int"))
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    roles = [F.struct(F.lit(1).alias("role"), every("blocks_a").alias("a"), own("blocks_b").alias("b")), F.when(F.col("c") != F.col("main"), F.struct(F.lit(0).alias("role"), own("blocks_a").alias("a"), every("blocks_b").alias("b")))]
    near = near.select(*lists_of, "node", F.explode(F.array_compact(F.array(*roles))).alias("r"))
    near = near.select(*lists_of, "node", "r.role", F.explode("r.a").alias("ba"), "r.b").select(*lists_of, "node", "role", "ba", F.explode("b").alias("bb"))
    near = near.join(placed.select("node", "n", "c", "bits"), "node")
    keys = [*lists_of, "ba", "bb"]
    pairs = near.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(_cross(percent)), "a long, b long")
    return write_table(pairs, "across").distinct()


def _classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, n, component of every row of docs (id, text)."""
    texts = docs.filter(F.col("id").isNotNull())
    common = texts.select("text").mapInArrow(released(_low(shingle)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    common = common.filter(F.col("n") > HEAVY).orderBy(F.desc("n"), "h").limit(MAX_HEAVY).select("h")
    heavy = np.sort(common.toArrow().column("h").to_numpy().view(np.uint64))
    schema = "id long, n long, d1 long, d2 long, light long, grp long, prefix array<long>, bits binary"
    rows = write_table(docs.mapInArrow(released(_prefixes(shingle, heavy)), schema), "prefixes")
    first = lambda c: F.first(c).alias(c)
    nodes = rows.filter("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("first_id"), first("n"), first("light"), first("grp"), F.first("bits", ignorenulls=True).alias("bits"))
    nodes = write_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = nodes.groupBy("grp").agg(F.min("node").alias("rep"))

    postings = rows.filter("prefix IS NOT NULL").select(F.posexplode("prefix").alias("place", "h"), "n", "light", "grp")
    postings = postings.repartition("h").sortWithinPartitions("h", "n", "grp")
    lists = write_table(postings.mapInArrow(released(_lists(percent)), "h long, grp long, shared boolean, leader long"), "lists")

    # rows of one id are one document: its other sets are tied to the first
    of_id = write_table(rows.filter("d1 IS NOT NULL").select("id", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("id", "node"), "ids")
    firsts = of_id.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("high"))
    tied = firsts.filter("a < high").select("id", "a").join(of_id, "id").select("a", F.col("node").alias("b")).filter("a < b")

    # round one: members of a group with its first, groups of a list with their leader
    inside = nodes.join(groups, "grp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    across = lists.filter("grp <> leader").select("grp", "leader").distinct()
    across = across.join(groups.select("grp", F.col("rep").alias("a")), "grp").join(groups.select(F.col("grp").alias("leader"), F.col("rep").alias("b")), "leader")
    one = _verify(inside.unionByName(across.select("a", "b")), docs, nodes, shingle, percent)
    links = write_table(one.filter("linked").select("a", "b").unionByName(tied), "links")
    labels = connected_components(links)

    # round two: what is left between components of one list or group
    placed = nodes.join(labels, "node", "left").select("node", "n", "light", "grp", "bits", F.coalesce("component", "node").alias("c"))
    placed = write_table(placed, "placed")
    pairs = _candidates(lists, placed, percent).join(one.select("a", "b"), ["a", "b"], "left_anti")
    two = _verify(pairs, docs, nodes, shingle, percent)
    # links of the second round join components of the first
    parts = placed.select("node", "c")
    ends = two.filter("linked").join(parts.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a")
    ends = ends.join(parts.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = connected_components(ends).withColumnRenamed("node", "c")

    # a component's name is its smallest id
    named = nodes.select("node", "first_id").join(parts, "node").join(joined, "c", "left").select("node", "first_id", F.coalesce("component", "c").alias("c"))
    named = named.join(named.groupBy("c").agg(F.min("first_id").alias("component_id")), "c").select(F.col("node").alias("a"), "component_id")
    ids = rows.select("id", "n").join(firsts.select("id", "a"), "id", "left").join(named, "a", "left")
    return ids.select("id", "n", F.coalesce("component_id", "id").alias("component"))


def near_documents(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row of docs. percent: the least similarity, 75 or more."""
    if percent < 75:
        raise ValueError("prefixes of a quarter need a similarity of 0.75 at least")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    outer = around()
    with scratch(spark):
        found = write_table(_classes(docs, shingle, percent), "classes", outer)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but of every component only those of the smallest id.

    Rows of one id are one document and stay or go together; rows without id stay.
    """
    found = near_documents(docs, shingle, percent, id_col, text_col)
    gone = found.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


#: The same for the test tables, by counting the common shingles of all pairs that have any.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT row_number() OVER () AS r, doc_id, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s, len(w) AS m FROM d),
sized AS (SELECT r, doc_id, CASE WHEN m = 0 THEN 0 ELSE len(s) END AS n, s FROM sets),
grams AS (SELECT r, doc_id, n, unnest(s) AS g FROM sized WHERE n > 0 AND doc_id IS NOT NULL),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r AND a.n * 100 >= 75 * b.n AND b.n * 100 >= 75 * a.n
  GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs WHERE x <> y UNION SELECT y, x FROM pairs WHERE x <> y),
roots AS (SELECT x FROM edges GROUP BY x HAVING min(y) > x),
reach AS (SELECT x AS root, x AS node FROM roots UNION SELECT root, y FROM reach JOIN edges ON node = x),
part AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM sized LEFT JOIN part ON node = doc_id
"""
