"""Fuzzy duplicate lines by MinHash, banding, exact Jaccard check and union-find, in DataFrame operations."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirefold.llm.common import components, lower_ascii, query, store, table

#: Characters of a shingle, minima of a signature; 16 bands of 5 minima (``_BAND_ROWS``).
SHINGLE, MINIMA = 8, 20
#: Shingles that one row of the signature job takes; bits of the filter for lines to read again.
TOGETHER, FILTER_BITS = 16, 25
#: Members of a star whose differences tell the frequent ones; so many of these are put last.
SAMPLE, FREQUENT = 256, 4096
#: Copies up to which a line with more of them has a smaller number.
MOST_COPIES = 4095

_fixed = random.Random(1)
#: The least ``hash ^ mask`` is the hash nearest to the mask: any shingle is as likely as any other.
#: Masks differ in their first bits, so minima of one line are seldom the same shingle.
_MASKS = [((i * 32 // MINIMA) << 27 | _fixed.getrandbits(27)) - (1 << 31) for i in range(MINIMA)]
#: Bands are the lines y = a x + b of the plane over the field of four, with one more minimum for each a: no two
#: share two minima, so that fewest similar lines agree in none (2.5% at 0.8; 4.3% with bands drawn at random).
_TIMES = ((0, 0, 0, 0), (0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 1, 2))
_BAND_ROWS = [[*(4 * x + (_TIMES[a][x] ^ b) for x in range(4)), 16 + a] for a in range(4) for b in range(4)]


def normal_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: lines with a word, white space runs as one blank, none outside,
    A-Z lower-cased."""
    raw = F.col("raw")
    blanks = [F.contains(raw, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")]
    odd = blanks[0] | blanks[1] | blanks[2] | blanks[3] | blanks[4]
    lines = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
             .where(raw.rlike(r"[^ \x09-\x0D]"))
             .select("doc_id", F.col("line_no").cast("long").alias("line_no"),
                     F.trim(F.when(odd, F.regexp_replace("raw", r"[ \x09\x0B-\x0D]+", " ")).otherwise(raw)).alias("raw")))
    ascii_only = F.octet_length("raw") == F.char_length("raw")
    return lines.select("doc_id", "line_no", F.when(ascii_only, F.lower("raw")).when(raw.rlike("[A-Z]"), lower_ascii(raw))
                        .otherwise(raw).alias("line"))


def signatures(lines: DataFrame) -> DataFrame:
    """One row per distinct line: ``k1, k2, copies, m0, m1, ...`` (its minima)."""
    shingled = (lines.select("k1", "k2", F.encode("line", "UTF-32").alias("chars"))
                .select("k1", "k2", "chars", F.greatest(F.octet_length("chars") - (4 * SHINGLE - 1), F.lit(1)).alias("last"))
                .select("k1", "k2", "chars", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(4 * TOGETHER))).alias("at")))
    # a row hashes its shingles before it meets its line's minima; behind the last one it takes that again
    hashes = [F.hash(F.substring("chars", F.least(F.col("at") + 4 * j, "last"), F.lit(4 * SHINGLE))).alias(f"h{j}") for j in range(TOGETHER)]
    least = [F.min(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(mask)) for j in range(TOGETHER)))).alias(f"m{i}") for i, mask in enumerate(_MASKS)]
    copies = F.sum((F.col("at") == 1).cast("int")).alias("copies")
    return shingled.select("k1", "k2", "at", *hashes).groupBy("k1", "k2").agg(copies, *least)


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a unique ``id``: smaller the more copies, by partition and row among these."""
    n = F.monotonically_increasing_id()
    return nodes.withColumn("row", n).withColumn("id", F.shiftleft(MOST_COPIES - F.least("copies", F.lit(MOST_COPIES)), 51).bitwiseOR(
        F.shiftleft(F.shiftright("row", 33), 31)).bitwiseOR(F.col("row").bitwiseAND(F.lit((1 << 31) - 1)))).drop("row")


def stars(nodes: DataFrame) -> DataFrame:
    """``hub, id``: every line of a block with the block's line of most copies."""
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"m{i}" for i in rows)) for b, rows in enumerate(_BAND_ROWS)))
    entries = nodes.select("id", F.explode(bands).alias("band"))
    hub = F.first("id").over(Window.partitionBy("band").orderBy("id"))
    return entries.select("id", hub.alias("hub")).where("id <> hub").select("hub", "id").distinct()


def _bit(k: Column) -> tuple[Column, Column]:
    at = F.pmod(k, F.lit(1 << FILTER_BITS))
    return F.shiftright(at, 15), at.bitwiseAND(F.lit((1 << 15) - 1))


def _texts(ids: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, line`` of ``ids``: lines pass a bitmap of fixed size before any is shuffled."""
    wanted = store(nodes.select("id", "k1", "k2").join(ids, "id", "left_semi"))
    block, bit = _bit(F.col("k1"))
    maps = (wanted.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = (lines.select("k1", "k2", "line", block.alias("block"), bit.alias("bit")).join(F.broadcast(maps), "block")
           .where(F.getbit(byte, F.col("bit").bitwiseAND(F.lit(7)).cast("int")) == 1)
           .dropDuplicates(["k1", "k2"]))
    return store(met.join(wanted, ["k1", "k2"]).select("id", "line"))


def shingle_set(line: str) -> Column:
    """Hashes of the distinct runs of ``SHINGLE`` characters of a line; of a shorter one, of itself."""
    runs = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))
    runs = F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(runs)
    return F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x)))


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(hub, id)`` -> also ``n, n_hub`` (distinct shingles) and ``diff`` (those of one alone)."""
    sets = (pairs.join(texts, "id").join(texts.toDF("hub", "hub_line"), "hub")
            .select("hub", "id", shingle_set("line").alias("s"), shingle_set("hub_line").alias("h")))
    return sets.select("hub", "id", F.size("s").alias("n"), F.size("h").alias("n_hub"),
                       F.concat(F.array_except("s", "h"), F.array_except("h", "s")).alias("diff"))


def linked(n1, n2, apart) -> Column:
    """Jaccard similarity of at least 0.8, by the sizes of two sets and of their symmetric difference."""
    return 9 * apart <= n1 + n2


def _ordered(apart: DataFrame) -> DataFrame:
    """``diff`` with what many rows of a star differ by at its end, in one order for each hub."""
    sizes = apart.groupBy("hub").agg(F.count("*").alias("m"))
    seen = (apart.join(sizes, "hub").where(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.floor(F.col("m") / SAMPLE))) == 0)
            .select("hub", F.explode("diff").alias("e")).groupBy("hub", "e").agg(F.count("*").alias("c")).where("c > 1"))
    often = (seen.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("c", "e")), False).alias("often"))
             .select("hub", F.reverse(F.slice("often.e", 1, FREQUENT)).alias("often")))
    often_first = F.coalesce("often", F.array().cast("array<long>"))
    return apart.join(often, "hub", "left").withColumn(
        "diff", F.concat(F.sort_array(F.array_except("diff", often_first)), F.array_intersect(often_first, "diff"))).drop("often")


def rest_links(star: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between lines of one star that are in different components.

    Be x and y two such lines, a and b the sizes of their differences from the hub. At most one of
    them is linked with the hub, so with s = size of x + size of y, x and y can only be linked if they
    share c >= (9 (a + b) - s) / 18 > 0 of these differences. In one order of all differences the
    first shared one then has c - 1 or more of either's behind it: rare ones come first, and only
    rows that meet there are compared.
    """
    placed = star.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (placed.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("hub"))
    apart = store(_ordered(placed.join(mixed, "hub")).withColumn("row", F.monotonically_increasing_id()))
    a = F.size("diff")
    # the other's size is at most 5/4, and its difference at least a - s / 9; is this line linked with
    # the hub, the other is not, and differs from it by more than a ninth of both sizes
    least = F.greatest(F.lit(1), F.ceil((36 * a - 9 * F.col("n")) / 36),
                       F.when(linked(F.col("n"), F.col("n_hub"), a), F.ceil((9 * a + F.col("n_hub") - F.col("n")) / 18)))
    rows = (apart.select("hub", "row", "component", "n", a.alias("a"), F.posexplode(F.slice("diff", 1, (a - least + 1).cast("int"))).alias("p", "e"))
            .select("row", "component", "n", "a", "p", F.xxhash64("hub", "e").alias("e")).repartition("e"))
    x, y = rows.alias("x"), rows.alias("y")
    need = 9 * (F.col("x.a") + F.col("y.a")) - F.col("x.n") - F.col("y.n")
    met = (x.join(y, F.col("x.e") == F.col("y.e"))
           .where((F.col("x.component") < F.col("y.component"))
                  & (18 * (F.col("x.a") - F.col("x.p")) >= need) & (18 * (F.col("y.a") - F.col("y.p")) >= need)
                  & (4 * F.col("x.n") <= 5 * F.col("y.n")) & (4 * F.col("y.n") <= 5 * F.col("x.n")))
           .select(F.col("x.row").alias("x"), F.col("y.row").alias("y")).distinct())
    part = apart.select("row", "hub", "id", "n", "diff")
    both = (met.join(part.toDF("x", "hub", "a", "n_a", "d_a"), "x").join(part.toDF("y", "hub_b", "b", "n_b", "d_b"), "y")
            .where("hub = hub_b"))
    shared = F.size(F.array_intersect("d_a", "d_b"))
    return both.where(linked(F.col("n_a"), F.col("n_b"), F.size("d_a") + F.size("d_b") - 2 * shared)).select("a", "b").distinct()


def similar_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: ``doc_id, line_no, kept, first_doc_id, first_line_no``.

    Equal normal lines are one node. Bands of 5 of ``MINIMA`` minima of hashed character
    shingles make blocks; in each block every line is paired with the one that has most copies,
    pairs are checked by their exact Jaccard similarity, and union-find joins what is linked. Lines
    of one star that are still apart are compared where they share enough of their differences
    from its hub (``rest_links``): no other pair of them can be linked. The first line (by doc_id,
    then line number) of a component is kept. A line of fewer characters than a shingle is one
    shingle. Null and empty texts have no lines, as has an empty table; repeated rows count as
    lines of their own.
    """
    # keys of 128 bits: two hashes with seeds of their own
    lines = store(normal_lines(docs).withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(1), "line")))
    nodes = store(_numbered(signatures(lines)))
    pairs = store(stars(nodes))
    texts = _texts(pairs.select("id").union(pairs.select("hub")).distinct(), nodes, lines)
    star = store(differences(pairs, texts))
    links = store(star.where(linked(F.col("n"), F.col("n_hub"), F.size("diff"))).select(F.col("hub").alias("a"), F.col("id").alias("b")))
    comps = store(components(links))
    rest = store(rest_links(star, comps))
    comps = components(comps.toDF("a", "b").union(rest))
    node = nodes.join(comps.withColumnRenamed("node", "id"), "id", "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("component"))
    rows = store(lines.select("doc_id", "line_no", "k1", "k2").join(node, ["k1", "k2"]).select("doc_id", "line_no", "component"))
    lowest = rows.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("f"))
    f = F.col("f")
    return (rows.join(lowest, "component")
            .select("doc_id", "line_no", (F.col("doc_id").eqNullSafe(f.doc_id) & (F.col("line_no") == f.line_no)).alias("kept"),
                    f.doc_id.alias("first_doc_id"), f.line_no.alias("first_line_no")))


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    return similar_lines(table(spark, sf_dir, "documents"))
