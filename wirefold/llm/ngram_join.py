"""Exact Jaccard join of documents on word shingles: count-vector R-trees over rare-shingle blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.common import components, query, release, store, table, text_batches
from wirefold.llm.words import bitmap, in_bitmap, shingles, word_hashes

#: Words of a shingle, similarity in percent, groups that shingles are counted in.
SHINGLE, PERCENT, GROUPS = 5, 80, 256
#: Shingles that so many documents have among their first 3/2 prefixes come last in the order, and
#: with them whatever falls on the same bits of a filter of 2^HOT_BITS bits (8 MB).
HOT_LEAST, HOT_BITS = 6, 26
#: Rows of a block that one R-tree takes; bits of the filter for texts to read again; entries of a
#: tree node, and of a block that is a single one; partners that share a copy of a set in the last check.
TILE, FILTER_BITS, FANOUT, ONE_NODE, PARTNERS = 2_048, 25, 16, 32, 256
#: Members of a block, picked by hash, that everyone who is still apart from them is paired with.
HUBS = 8


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words, one hash of them all; of none, nothing."""
    h = word_hashes(text)
    s = shingles(h, min(SHINGLE, max(1, len(h))))
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def prefix_size(n: int) -> int:
    """Of two sets with the wanted similarity, each has a common element among so many of its
    first, in any one order of all elements."""
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def linked(inter, n1, n2):
    return 100 * inter >= PERCENT * (n1 + n2 - inter)


def group_counts(s: np.ndarray) -> bytes:
    """The point of a set: how many of its shingles fall into each group, one byte each (two or
    four for sets that need it)."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    top = counts.max()
    return counts.astype("u1" if top < 256 else "<u2" if top < 65_536 else "<u4").tobytes()


def points(raw) -> np.ndarray:
    """(rows, groups) from the bytes of ``group_counts``."""
    raw = list(raw)
    if all(len(r) == GROUPS for r in raw):
        return np.frombuffer(b"".join(raw), "u1").reshape(-1, GROUPS).astype(np.int32)
    kinds = {GROUPS: "u1", 2 * GROUPS: "<u2", 4 * GROUPS: "<u4"}
    return np.stack([np.frombuffer(r, kinds[len(r)]).astype(np.int32) for r in raw])


class CountTree:
    """R-tree over count vectors, bulk-loaded in order of size. A node knows, for what is below it,
    the largest count of each group and the smallest and largest size; no set below can share more
    elements with a query than the sum over groups of the smaller of both counts."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((counts.argmax(1), sizes))
        self.order, self.levels = order, []
        high, low_n, high_n = counts[order], sizes[order], sizes[order]
        self.levels.append((high, low_n, high_n))
        while len(high) > FANOUT:
            at = np.arange(0, len(high), FANOUT)
            high, low_n, high_n = (np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at),
                                   np.maximum.reduceat(high_n, at))
            self.levels.append((high, low_n, high_n))

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points that may be linked to the query."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(high, counts).sum(1)
            # sizes in [low, high] can be no further than the similarity allows, and sharing
            # `bound` elements has to be enough with the smallest of them
            ok = (100 * high_n >= PERCENT * size) & (100 * size >= PERCENT * low_n)
            ok &= linked(bound, size, np.maximum(low_n, bound))
            nodes = nodes[ok]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def _prefixes(batches):
    release()
    for batch in batches:
        out = [s[:prefix_size(len(s)) * 3 // 2] for s in map(shingle_set, batch.column("text").to_pylist())]
        out = np.concatenate([np.empty(0, np.uint64), *out]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out)], names=["token"])


def _profiles(hot):
    """Per document: size, digest and count vector of its set, and its prefix when shingles in the
    filter ``hot`` come last and hashes order the rest."""
    def rows(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                known = in_bitmap(hot.value, s)
                prefix = np.concatenate([s[~known], s[known]])[:prefix_size(len(s))]
                out.append((len(s), int.from_bytes(d[:8], "little", signed=True),
                            int.from_bytes(d[8:], "little", signed=True), group_counts(s),
                            prefix.view(np.int64)))
            n, d1, d2, counts, prefixes = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64()), pa.array(counts, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "d1", "d2", "counts", "prefix"])

    return rows


def _pairs_within(batches):
    """Rows sorted by block -> pairs of different components that the count vectors let through.
    ``side`` tells the tiles of a block apart: 0 for a tile against itself, else 1 and 2."""
    def small(counts, sizes, ids, comps, side, bounds):
        """All blocks of one tree node at once."""
        a, b = (np.concatenate([x[i] + at for at, x in bounds]) for i in (0, 1))
        ok = (comps[a] != comps[b]) & ((side[a] == side[b]) & (side[a] == 0) | (side[a] + side[b] == 3))
        ok &= (100 * sizes[a] >= PERCENT * sizes[b]) & (100 * sizes[b] >= PERCENT * sizes[a])
        a, b = a[ok], b[ok]
        pairs, first = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1),
                                 axis=0, return_index=True)
        a, b = a[first], b[first]
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 4_096):
            x, y = a[i:i + 4_096], b[i:i + 4_096]
            keep[i:i + 4_096] = linked(np.minimum(counts[x], counts[y]).sum(1), sizes[x], sizes[y])
        return pairs[keep]

    def large(counts, sizes, ids, comps, side):
        tree, out = CountTree(counts, sizes), []
        for i in np.flatnonzero(side <= 1):
            near = tree.search(counts[i], int(sizes[i]))
            near = near[(comps[near] != comps[i]) & ((side[near] == 2) | (side[i] == 0) & (ids[i] < ids[near]))]
            out += [(min(ids[i], j), max(ids[i], j)) for j in ids[near].tolist()]
        return np.array(out, np.int64).reshape(-1, 2)

    key, rest, rows_of = ["token", "i", "j"], None, {m: np.triu_indices(m, 1) for m in range(1, ONE_NODE + 1)}

    def found(pdf, starts):
        cols = [points(pdf.counts), *(pdf[c].to_numpy() for c in ("n", "class_id", "component", "side"))]
        ends = [*starts[1:], len(pdf)]
        little = [(a, rows_of[b - a]) for a, b in zip(starts, ends) if 1 < b - a <= ONE_NODE]
        out = [small(*cols, little)] if little else []
        out += [large(*(c[a:b] for c in cols)) for a, b in zip(starts, ends) if b - a > ONE_NODE]
        pairs = np.concatenate([np.empty((0, 2), np.int64), *out])
        return pd.DataFrame(pairs, columns=["a", "b"]).drop_duplicates()

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        change = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(1)) + 1
        starts = [0, *change.tolist()]
        rest = pdf.iloc[starts[-1]:]
        if len(starts) > 1:
            yield found(pdf.iloc[:starts[-1]], starts[:-1])
    if rest is not None and len(rest):
        yield found(rest.reset_index(drop=True), [0])


def _bounded(batches):
    """Pairs whose count vectors allow the wanted overlap."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (points(batch.column(c).to_pylist()) for c in ("counts_a", "counts_b"))
        n1, n2 = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        ok = linked(np.minimum(a, b).sum(1), n1, n2)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))


def _sets(wanted):
    def rows(batches):
        for batch in batches:
            hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_bitmap(wanted.value, hashes.view(np.uint64))))
            sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sets, pa.binary())],
                                             names=["doc_id", "text_hash", "elements"])
    return rows


def _stored_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _verified(read):
    """Rows sorted by (a, salt, b), the set of ``a`` first (``b`` null) -> links."""
    def rows(batches):
        key = own = None
        for batch in batches:
            out = []
            cols = (batch.column(c) for c in ("a", "salt", "b", "elements"))
            for a, salt, b, raw in zip(*(c.to_pylist() for c in cols)):
                s = read(raw)
                if b is None:
                    key, own = (a, salt), s
                    continue
                if key != (a, salt):
                    raise ValueError("a pair came without the set of its first member")
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                if linked(int((own[at] == s).sum()), len(own), len(s)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows


def verify_pairs(pairs: DataFrame, sets: DataFrame, read=_stored_set) -> DataFrame:
    """Exact check of ``pairs(a, b)`` against ``sets(class_id, elements)``; ``read`` gives the sorted
    distinct elements. Pairs meet the set of their first member in parts of about ``PARTNERS``, so
    one much-paired set spreads out."""
    salts = pairs.groupBy("a").agg((F.floor(F.count("*") / PARTNERS) + 1).alias("salts"))
    members = (pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
               .join(sets.withColumnRenamed("class_id", "b"), "b").select("a", "salt", "b", "elements"))
    firsts = (salts.join(sets.withColumnRenamed("class_id", "a"), "a")
              .select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"),
                      F.lit(None).cast("long").alias("b"), "elements"))
    return (members.unionByName(firsts).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
            .mapInArrow(_verified(read), "a long, b long"))


def _keyed(docs: DataFrame) -> DataFrame:
    return text_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def _counted(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    return (pairs.join(profiles.toDF("a", "n_a", "counts_a"), "a").join(profiles.toDF("b", "n_b", "counts_b"), "b")
            .select("a", "b", "n_a", "n_b", "counts_a", "counts_b"))


def _apart(entries: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the blocks that are not yet one component."""
    placed = (entries.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
              .select("token", "m", "class_id", "n", F.coalesce("component", "class_id").alias("component")))
    mixed = (placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("token"))
    return placed.join(mixed, "token")


def _hub_pairs(apart: DataFrame) -> DataFrame:
    """``a, b``: each row of a block with the block's ``HUBS`` hubs that it is apart from and whose
    size allows a link. A hub has the smallest hash of its block, so the blocks of one group of
    copies agree on theirs, and a row has few partners however many blocks it shares with them."""
    picks = [F.min(F.struct(F.xxhash64("class_id", F.lit(i)), "class_id", "component", "n")).alias(f"h{i}") for i in range(HUBS)]
    hubs = apart.groupBy("token").agg(*picks).select("token", F.array(*(f"h{i}" for i in range(HUBS))).alias("hubs"))
    far = lambda h: ((h.component != F.col("component"))
                     & (100 * F.least(h.n, F.col("n")) >= PERCENT * F.greatest(h.n, F.col("n"))))
    met = (apart.join(hubs, "token")
           .select("class_id", F.array_distinct(F.transform(F.filter("hubs", far), lambda h: h.class_id)).alias("hubs"))
           .where(F.size("hubs") > 0).distinct())
    return (met.select("class_id", F.explode("hubs").alias("hub"))
            .select(F.least("class_id", "hub").alias("a"), F.greatest("class_id", "hub").alias("b")).distinct())


def similar_components(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document row: ``doc_id, text_hash, n_shingles,
    component_id`` (the smallest doc_id that links lead to), ``component`` (a key of the component,
    also where ids are null or repeated; null without words).

    1. Documents with equal sets form a class; the rest works on one member of each.
    2. A pair with the wanted similarity shares a shingle of both prefixes, in any one order of all
       shingles. The order is rare ones first: by hash, with those put last that ``HOT_LEAST``
       documents or more have early (counted over all documents, kept as a fixed-size filter whose
       false alarms only reorder). Classes that share a prefix shingle make a block.
    3. In each block everyone is paired with its first class; pairs that sizes and count vectors
       allow are checked exactly, and union-find joins what is linked. In blocks that are not yet
       one component, everyone is then paired in the same way with ``HUBS`` members picked by hash.
    4. What is still apart inside a block goes through an R-tree of count vectors (blocks of more
       than ``TILE`` rows as pairs of tiles, so no task holds a whole hot block); surviving pairs
       are checked exactly and joined. So every linked pair is either tested or already connected.

    No caps: all pairs of a block that are not already in one component are bounded. A document
    without words has an empty set and stays alone, as does a null text. Repeated rows fall into
    one class. An empty table gives no rows.
    """
    sc, keyed = docs.sparkSession.sparkContext, _keyed(docs)
    tokens = docs.select("text").mapInArrow(_prefixes, "token long").groupBy("token").agg(F.count("*").alias("n"))
    hot = sc.broadcast(bitmap(tokens.where(F.col("n") >= HOT_LEAST), "token", HOT_BITS))
    base = store(keyed.mapInArrow(_profiles(hot), "doc_id long, text_hash long, n long, d1 long, d2 long, "
                                                  "counts binary, prefix array<long>")
                 .withColumn("row", F.monotonically_increasing_id()))
    classes = store(base.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("class_id"), F.min("doc_id").alias("first_doc")))
    members = (base.join(classes.select(F.col("class_id").alias("row")), "row", "left_semi")
               .withColumnRenamed("row", "class_id"))
    entries = members.select("class_id", "n", F.explode("prefix").alias("token")).repartition("token")
    first = (entries.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("class_id", "n")).alias("f"))
             .where("m > 1").select("token", "m", F.col("f.class_id").alias("first"), F.col("f.n").alias("n_first")))
    entries = store(entries.join(first, "token"))  # blocks of two or more
    stars = (entries.where("class_id <> first").where(f"100 * least(n, n_first) >= {PERCENT} * greatest(n, n_first)")
             .select(F.col("first").alias("a"), F.col("class_id").alias("b")).distinct())
    profiles = members.select("class_id", "n", "counts")
    stars = store(_counted(stars, profiles).mapInArrow(_bounded, "a long, b long"))
    links = store(verify_pairs(stars, _sets_of(stars, members, keyed)))
    comps = store(components(links))
    hubs = _hub_pairs(_apart(entries, comps)).join(stars, ["a", "b"], "left_anti")
    hubs = store(_counted(hubs, profiles).mapInArrow(_bounded, "a long, b long"))
    tested = stars.union(hubs)
    near = store(verify_pairs(hubs, _sets_of(hubs, members, keyed)))
    # what is known so far, as each class with its component, and the links of the hubs
    links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(near)
    comps = store(components(links))
    tiles = F.ceil(F.col("m") / TILE)
    tile = F.pmod(F.xxhash64("class_id"), tiles)
    cells = (_apart(entries, comps).join(profiles.select("class_id", "counts"), "class_id")
             .withColumn("tile", tile).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
             .select("token", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"),
                     F.when(F.col("tile") == F.col("k"), 0).when(F.col("tile") < F.col("k"), 1).otherwise(2).alias("side"),
                     "class_id", "component", "n", "counts"))
    pairs = (cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "class_id")
             .mapInPandas(_pairs_within, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"))
    pairs = store(pairs)
    more = store(verify_pairs(pairs, _sets_of(pairs, members, keyed)))
    comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    whole = classes.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    whole = whole.withColumn("component", F.coalesce("component", "class_id"))
    lowest = whole.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    whole = whole.join(lowest, "component").select("d1", "d2", "component", "component_id")
    return (base.join(whole, ["d1", "d2"], "left")
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "component"))


def _sets_of(pairs: DataFrame, members: DataFrame, keyed: DataFrame) -> DataFrame:
    """``class_id, elements`` of the classes in ``pairs``: their texts are found by a fixed-size
    filter on the text's hash, read again, and joined exactly."""
    wanted = (members.select("class_id", "doc_id", "text_hash")
              .join(pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).distinct(), "class_id", "left_semi"))
    wanted = store(wanted)
    known = keyed.sparkSession.sparkContext.broadcast(bitmap(wanted, "text_hash", FILTER_BITS))
    sets = keyed.mapInArrow(_sets(known), "doc_id long, text_hash long, elements binary")
    on = sets.text_hash.eqNullSafe(F.col("w_hash")) & sets.doc_id.eqNullSafe(F.col("w_doc"))
    sets = sets.join(wanted.toDF("class_id", "w_doc", "w_hash"), on)
    return store(sets.groupBy("class_id").agg(F.first("elements").alias("elements")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document row of each component, the one with the smallest doc_id (ties by text), and
    every row without words; columns of ``docs`` stay. Null and repeated ids link nothing."""
    found = store(similar_components(docs))
    worded = found.where("n_shingles > 0")
    best = (worded.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
            .select("k.doc_id", "k.text_hash"))
    rows = worded.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    on = lambda x, y: x.doc_id.eqNullSafe(y.doc_id) & (x.text_hash == y.text_hash)
    kept = store(best.alias("x").join(rows.alias("y"), on(best, rows)).select("x.doc_id", "x.text_hash", "y.times"))
    empty = found.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(1).cast("long").alias("times")).distinct()
    keys = kept.union(empty).toDF("_k_doc", "_k_text", "_k_times")
    out = docs.join(keys, docs.doc_id.cast("long").eqNullSafe(F.col("_k_doc")) & (F.xxhash64(docs.text) == F.col("_k_text")))
    once = out.where("_k_times = 1").select(*docs.columns)
    again = out.where("_k_times > 1").dropDuplicates(["_k_doc", "_k_text"]).select(*docs.columns)
    return once.union(again)


@query("op9_ngram_join")
def op9_ngram_join(spark, sf_dir):
    return (similar_components(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_shingles", "component_id"))
