"""Reply graphs: depth, edges, induced subgraphs, similarity neighbours and graph statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch
from ..skew import PARTS, hot_join, hot_keys
from .components import components
from .nearest import nearest

BLOCK = 4096
GRID, PART_ROWS = 8, 131_072
RANGE_ROWS = 1_000_000
FAN, DEPTH, DRAWN = 64, 5, 4
WEDGE_BLOCK = 1000


def _to_ends(links: DataFrame, ends: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, end, steps, done) for each of ``links`` (id, parent), which each have one parent: the end reached, by pointer doubling.

    Rounds are logarithmic in the longest chain. A chain that runs into a circle without an end stays undone; rounds end
    when no chain can be longer.
    """
    stop = ends.select(F.col("id").alias("end"), F.lit(True).alias("stop"))
    state = links.select("id", F.col("parent").alias("end"), F.lit(1).cast("long").alias("steps"))
    state = hot_join(state, stop, "end", hot_keys(state, "end"), "left").select("id", "end", "steps", F.coalesce("stop", F.lit(False)).alias("done"))
    state = scratch.write(state, f"{tag}0")
    open_, reach, round_ = state.where("NOT done").count(), 1, 0
    longest = open_ + 1
    while open_ and reach <= 2 * longest:
        over = state.select(F.col("id").alias("end"), F.col("end").alias("e2"), F.col("steps").alias("s2"), F.col("done").alias("d2"))
        going = state.where("NOT done")
        jump = hot_join(going, over, "end", hot_keys(going, "end", open_), "left")
        jump = jump.select("id", F.coalesce("e2", "end").alias("end"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.coalesce("d2", F.lit(True)).alias("done"))
        state = scratch.write(state.where("done").unionByName(jump), f"{tag}{round_ + 1}")
        scratch.drop(f"{tag}{round_}")
        open_, reach, round_ = state.where("NOT done").count(), reach * 2, round_ + 1
    return state


def reply_depth(tweets: DataFrame) -> DataFrame:
    """(tweet_id, depth) of (tweet_id, conversation_id, parent_id); ids are unique.

    A root (its own conversation) has depth 0; a tweet whose parent is missing, the root, or not among the tweets has 1; any
    other one more than its parent. In a circle of replies the walk begins at the smallest id that leads into it: the
    first tweet of the circle so met counts 0 when the walk comes back to it, and that closes the count for all others.
    """
    scratch = Scratch(tweets.sparkSession, "reply-depth")
    ids = tweets.select(F.col("tweet_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = tweets.select("tweet_id", "conversation_id", "parent_id")
    base = hot_join(rows, ids, "parent_id", hot_keys(rows, "parent_id"), "left")  # roots, which have no parent, stay where they are
    depth = F.when(F.col("tweet_id").eqNullSafe(F.col("conversation_id")), 0).when(
        F.col("known").isNull() | F.col("parent_id").eqNullSafe(F.col("conversation_id")), 1
    )
    base = scratch.write(base.select(F.col("tweet_id").alias("id"), F.col("parent_id").alias("parent"), depth.cast("long").alias("depth")), "base")
    known, links = base.where("depth IS NOT NULL"), base.where("depth IS NULL").select("id", "parent")
    state = _to_ends(links, known, scratch, "chain")
    ended = state.where("done").join(known.select(F.col("id").alias("end"), "depth"), "end").select("id", (F.col("depth") + F.col("steps")).alias("depth"))
    out = known.select("id", "depth").unionByName(ended)
    lost = scratch.write(state.where("NOT done").select("id").join(links, "id"), "lost")
    if not lost.isEmpty():
        out = out.unionByName(_circle_depth(lost, state.where("NOT done"), scratch))
    return out.select(F.col("id").alias("tweet_id"), F.col("depth").cast("int").alias("depth"))


def _circle_depth(lost: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    circle = scratch.write(state.select(F.col("end").alias("id")).distinct(), "circle")  # jumps of more than any chain end in circles
    tails = lost.join(circle, "id", "left_anti")
    met = _to_ends(tails, circle, scratch, "tail")
    ring = components(lost.join(circle, "id").select(F.col("id").alias("a"), F.col("parent").alias("b")), scratch, "ring")
    alone = circle.join(ring, "id", "left").select(F.col("id").alias("end"), F.coalesce("component", "id").alias("ring"))
    ways = met.select("id", "end").unionByName(circle.select("id", F.col("id").alias("end")))
    entry = scratch.write(ways.join(alone, "end").groupBy("ring").agg(F.min_by("end", "id").alias("id")).select("id"), "entry")
    around = _to_ends(lost.join(circle, "id"), entry, scratch, "around").select("id", F.col("steps").alias("depth"))  # the entry walks its whole circle
    before = met.join(around.select(F.col("id").alias("end"), "depth"), "end").select("id", (F.col("steps") + F.col("depth")).alias("depth"))
    return around.unionByName(before)


def max_scaled(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the column over its maximum; NaN if that is 0."""
    top = df.agg(F.max(column).alias("__top"))  # one row
    return df.crossJoin(F.broadcast(top)).withColumn(f"{column}_scaled", F.when(F.col("__top") == 0, F.lit(float("nan"))).otherwise(F.col(column) / F.col("__top"))).drop("__top")


def vertex_index(df: DataFrame, key: str = "tweet_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``idx``, the rank of its key in the order of its type from 0.

    Keys are range-partitioned into about ``range_rows`` rows a range and counted by range, so no task ranks them all.
    """
    scratch = Scratch(df.sparkSession, "vertex-index")
    rows = scratch.write(df, "rows")
    ranges = scratch.write(rows.repartitionByRange(max(1, -(-rows.count() // range_rows)), key).withColumn("__part", F.spark_partition_id()), "ranges")
    scratch.drop("rows")
    counts = ranges.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return ranges.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn("idx", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def _both_ways(edges: DataFrame, kind: str) -> DataFrame:
    pairs = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(pairs).alias("e")).select("e.src", "e.dst", F.lit(kind).alias("kind"))


def reply_edges(tweets: DataFrame) -> DataFrame:
    """Edges in both directions between a tweet and its parent, where the parent is another one of the tweets."""
    child = tweets.where(F.col("parent_id") != F.col("tweet_id")).select(F.col("parent_id").alias("src"), F.col("tweet_id").alias("dst"))
    return _both_ways(hot_join(child, tweets.select(F.col("tweet_id").alias("src")), "src", hot_keys(child, "src"), "left_semi"), "reply")


def conversation_edges(tweets: DataFrame) -> DataFrame:
    """Edges in both directions between a conversation's root and each other tweet; a conversation without its root has none."""
    members = tweets.where(F.col("tweet_id") != F.col("conversation_id")).select(F.col("conversation_id").alias("src"), F.col("tweet_id").alias("dst"))
    roots = tweets.where(F.col("tweet_id") == F.col("conversation_id")).select(F.col("tweet_id").alias("src"))
    return _both_ways(hot_join(members, roots, "src", hot_keys(members, "src"), "left_semi"), "conversation")


def nearest_neighbours(vectors: DataFrame, k: int = 3, threshold: float = 0.75, block: int = BLOCK, part_rows: int | None = None) -> DataFrame:
    """(src, dst, similarity) of the k most similar other vectors of (id, vector) with a cosine over the threshold; ties to the smaller id.

    Every pair counts, so this is matrix products of blocks of about ``block`` vectors. Blocks are the leaves of a tree of pivots; a pair of blocks is left
    out, with all below it, if no pair of their vectors can reach the threshold, as angles obey the triangle inequality. On vectors without any
    clusters nothing is ruled out, and the products are quadratic; ``block_pairs`` tells how many of them are left.

    Vectors travel by parts, which are neighbouring blocks of a GRID-th of all rows, PART_ROWS at most (or ``part_rows``). A task holds two parts, multiplies the pairs
    of their blocks that are left, each once for both ends, and sends k results a vector. So a vector is sent GRID + 1 times at most, however many there
    are, until parts have grown to PART_ROWS. The result is written, as callers read it more than once.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = scratch.write(vectors.where("vector IS NOT NULL").select("id", "vector"), "vectors")
    total = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    pairs, dealt = _one_block(rows) if total <= block else _pivot_tree(rows, total, block, threshold, scratch)
    parts, tasks = _parts(pairs, dealt, part_rows or max(block, min(PART_ROWS, -(-total // GRID))), scratch)
    ends = tasks.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("part"))
    sent = dealt.join(parts, "b").join(ends, "part").select(*[F.col(c).alias(c) for c in ("low", "high", "b", "id", "vector")])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest(left, [(x["q"], x["c"]) for x in right["pairs"].to_pylist()[0]], k, threshold)

    found = sent.groupBy("low", "high").cogroup(tasks.groupBy("low", "high")).applyInArrow(best, f"src {kind}, dst {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    found = scratch.write(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "found")
    scratch.drop("vectors", "blocks")
    return found


def _parts(pairs: DataFrame, dealt: DataFrame, part_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(b, part): the blocks in the tree's order, dealt to parts of about ``part_rows``; (low, high, pairs): two parts and the pairs of their blocks that are left."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
    parts = scratch.write(dealt.groupBy("b").agg(F.count("*").alias("n")).select("b", F.floor(before / part_rows).alias("part")), "parts")
    of = lambda side, part: parts.select(F.col("b").alias(side), F.col("part").alias(part))
    left = pairs.where("q <= c").join(of("q", "low"), "q").join(of("c", "high"), "c")
    return parts, scratch.write(left.groupBy("low", "high").agg(F.collect_list(F.struct("q", "c")).alias("pairs")), "tasks")


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _apart(units: np.ndarray, wanted: int) -> np.ndarray:
    """As many of the rows, from the first on each the farthest from those before it."""
    chosen, closest = [0], units @ units[0]
    while len(chosen) < min(wanted, len(units)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, units @ units[chosen[-1]])
    return units[chosen]


def _one_block(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.sparkSession.createDataFrame([("0", "0")], "q string, c string"), rows.withColumn("b", F.lit("0"))


def _angle(x: str, y: str) -> Column:
    """Between two unit vectors."""
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))


def _split_cells(rows: DataFrame, big: DataFrame, block: int, fan: int) -> DataFrame:
    """(id, vector, cell, center, angle): the vectors of the cells in ``big`` (cell, n), each with the nearest of its cell's pivots.

    A cell's pivots are vectors of its own, about two a block and ``fan`` at most, each the farthest from those before it among DRAWN times as many that are drawn by hash (the
    vector of the least hash if none is). A cell is dealt over groups of about a block, each of which gets what was drawn.
    """
    wanted = F.least(F.lit(fan), F.ceil(2 * F.col("n") / block))
    marked = rows.join(F.broadcast(big) if big.count() <= PARTS else big, "cell")
    marked = marked.withColumn("whole", F.transform("vector", lambda v: v.cast("double")))
    drawn = F.pmod(F.xxhash64("id", "cell"), F.col("n")) < DRAWN * wanted
    one = marked.groupBy("cell", "n").agg(F.collect_list(F.when(drawn, F.col("whole"))).alias("pivots"), F.min_by("whole", F.xxhash64("id", "cell")).alias("least"))
    pivots = one.select("cell", "n", F.when(F.size("pivots") > 0, F.col("pivots")).otherwise(F.array("least")).alias("pivots"))  # about ``fan`` a cell
    salts = F.ceil(F.col("n") / block)
    asks = marked.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), salts).alias("salt"))
    gives = pivots.select(F.col("cell").alias("cell"), "pivots", wanted.cast("int").alias("wanted"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"id": [], "vector": [], "cell": [], "center": [], "angle": []})
        centers = _apart(np.unique(_unit(right["pivots"].iloc[0].tolist()), axis=0), int(right["wanted"].iloc[0]))
        cosine = np.clip(_unit(left["vector"].tolist()) @ centers.T, -1.0, 1.0)
        own = cosine.argmax(1)
        name = left["cell"] + "/" + own.astype(str)
        return pd.DataFrame({"id": left["id"], "vector": left["vector"], "cell": name, "center": [c.tolist() for c in centers[own]], "angle": np.arccos(cosine[np.arange(len(own)), own])})

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, vector {rows.schema['vector'].dataType.simpleString()}, cell string, center array<double>, angle double"
    return asks.groupBy("cell", "salt").cogroup(gives.groupBy("cell", "salt")).applyInPandas(nearest, kinds)


def _pivot_tree(rows: DataFrame, total: int, block: int, threshold: float, scratch: Scratch, fan: int = FAN, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(q, c) of the pairs of blocks that may hold neighbours, and the rows (id, vector, b) with their block.

    A tree of cells: those of over ``block`` vectors are split by pivots of their own, down to ``depth``. Two cells are compared only if their parents
    are close enough, by the angle between their pivots and the largest angles within them; so pairs of cells are looked at as far as there are
    close ones, not all of them. A cell that pivots don't split (equal vectors) is dealt to blocks by hash.
    """
    reach = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6
    session = rows.sparkSession
    state = scratch.write(rows.select("id", "vector", F.lit("").alias("cell")), "cells")
    pairs = session.createDataFrame([("", "")], "p string, o string")
    big = session.createDataFrame([("", total)], "cell string, n long")
    leaves: list[DataFrame] = []
    for level in range(depth):
        dealt = scratch.write(_split_cells(state, big, block, fan), f"dealt{level}")
        cells = dealt.groupBy("cell").agg(F.first("center").alias("center"), F.max("angle").alias("radius"), F.count("*").alias("n"))
        cells = scratch.write(cells.withColumn("parent", F.regexp_replace("cell", "/[^/]*$", "")), f"level{level}")
        end = level + 1 == depth
        more = cells.where(F.lit(not end) & (F.col("n") > block)).select("cell", "n")
        leaves.append(dealt.join(more, "cell", "left_anti").select("id", "vector", "cell"))
        # a pair's ends go on to their children, or stay if they have none
        of = lambda side, cells=cells: cells.select(F.col("parent").alias(side), F.col("cell").alias(f"{side}2"), F.col("center").alias(f"c{side}"), F.col("radius").alias(f"r{side}"))
        met = pairs.join(of("p"), "p", "left").join(of("o"), "o", "left")
        if level:
            known = tree.select("cell", "center", "radius")
            met = met.join(known.toDF("p", "dp", "ep"), "p", "left").join(known.toDF("o", "do", "eo"), "o", "left")
            met = met.withColumns({"cp": F.coalesce("cp", "dp"), "co": F.coalesce("co", "do"), "rp": F.coalesce("rp", "ep"), "ro": F.coalesce("ro", "eo")})
        pairs = met.where(_angle("cp", "co") <= reach + F.col("rp") + F.col("ro")).select(F.coalesce("p2", "p").alias("p"), F.coalesce("o2", "o").alias("o"))
        pairs = scratch.write(pairs, f"pairs{level}")
        tree = cells.drop("parent", "n") if not level else scratch.write(tree.unionByName(cells.drop("parent", "n")), f"tree{level}")
        big = scratch.write(more, f"big{level}")
        if big.isEmpty():
            break
        state = dealt.join(big.select("cell"), "cell", "left_semi").select("id", "vector", "cell")
    ended = leaves[0]
    for part in leaves[1:]:
        ended = ended.unionByName(part)
    ended = scratch.write(ended, "leaves")
    sizes = ended.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    sizes = scratch.write(sizes, "sizes")
    name = lambda part: F.concat_ws("#", "cell", part)
    dealt = hot_join(ended, sizes, "cell", hot_keys(ended, "cell")).select("id", "vector", name(F.pmod(F.xxhash64("id"), "parts")).alias("b"))
    every = sizes.select("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), name)).alias("b"))
    q, c = every.toDF("p", "q"), every.toDF("o", "c")
    return scratch.write(pairs.join(q, "p").join(c, "o").select("q", "c"), "pairs"), scratch.write(dealt, "blocks")


def block_pairs(vectors: DataFrame, threshold: float = 0.75, block: int = BLOCK) -> DataFrame:
    """One row: how many blocks the vectors (id, vector) make, and how many of their pairs (in order) are looked at for neighbours."""
    scratch = Scratch(vectors.sparkSession, "block-pairs")
    rows = scratch.write(vectors.where("vector IS NOT NULL").select("id", "vector"), "vectors")
    pairs, dealt = _pivot_tree(rows, rows.count(), block, threshold, scratch)
    return dealt.agg(F.count_distinct("b").alias("blocks")).crossJoin(pairs.agg(F.count("*").alias("pairs")))  # single rows


def neighbour_edges(vectors: DataFrame, k: int = 3, threshold: float = 0.75) -> DataFrame:
    """Each neighbour in both directions, kept as a multiset: mutual neighbours come twice."""
    return _both_ways(nearest_neighbours(vectors, k, threshold).select("src", "dst"), "similar")


def all_edges(tweets: DataFrame, vectors: DataFrame, k: int = 3, threshold: float = 0.75) -> DataFrame:
    return reply_edges(tweets).unionByName(conversation_edges(tweets)).unionByName(neighbour_edges(vectors, k, threshold))


def induced_subgraph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training vertices (id, is_train) with new indices, and the edges among them in these."""
    train = vertex_index(vertices.where("is_train"), "id")
    src, dst = (train.select(F.col("id").alias(x), F.col("idx").alias(f"{x}_idx")) for x in ("src", "dst"))
    return train, edges.join(src, "src").join(dst, "dst").select("src_idx", "dst_idx")


def simple_edges(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b once each."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id it is connected with."""
    found = components(simple_edges(edges), Scratch(edges.sparkSession, "components"), "c")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = simple_edges(edges).select(F.explode(F.array("a", "b")).alias("id"))
    count = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.select("id").join(count, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def wedges(pointed: DataFrame, block: int = WEDGE_BLOCK) -> DataFrame:
    """(u, x, y) with x < y of all pairs of ends of the arcs (u, v) of a vertex.

    A vertex's ends are dealt by hash into blocks of about ``block``, and each pair of blocks is a group of its own, so a task never has more than the
    square of a block to do for any one vertex; an arc is sent once per block of its vertex.
    """
    count = pointed.groupBy("u").agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = hot_join(pointed, count, "u", hot_keys(pointed, "u")).withColumn("own", F.pmod(F.xxhash64("v"), "blocks"))
    rows = rows.select("u", "v", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("u", "v", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    x, y = (rows.select("u", "low", "high", F.col("v").alias(c), F.col("own").alias(f"o{c}")) for c in ("x", "y"))
    # two ends of one block meet in its own group only
    return x.join(y, ["u", "low", "high"]).where("x < y AND (ox <> oy OR low = high)").select("u", "x", "y")


def clustering(vertices: DataFrame, edges: DataFrame, block: int = WEDGE_BLOCK) -> DataFrame:
    """(id, triangles, coefficient). Edges point from the end of lower degree, so a vertex has few wedges to close, and those are shared among tasks."""
    scratch = Scratch(edges.sparkSession, "clustering")
    plain = scratch.write(simple_edges(edges), "plain")
    ends = plain.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    degree = vertices.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    a, b = (ends.select(F.col("id").alias(x), F.col("degree").alias(f"d{x}")) for x in ("a", "b"))
    low = F.struct("da", "a") < F.struct("db", "b")
    met = hot_join(hot_join(plain, a, "a", hot_keys(plain, "a")), b, "b", hot_keys(plain, "b"))
    pointed = met.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    pointed = scratch.write(pointed, "pointed")
    closed = wedges(pointed, block).join(plain.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi")
    corners = closed.select(F.explode(F.array("u", "x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = degree.join(corners, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    share = F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))
    return out.select("id", "triangles", F.round(share, 6).alias("coefficient"))


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Components, connectedness, average clustering and average degree."""
    parts = connected_components(vertices, edges).agg(F.count_distinct("component").alias("n_components"))
    other = clustering(vertices, edges).agg(F.round(F.avg("coefficient"), 6).alias("average_clustering"))
    mean = degrees(vertices, edges).agg(F.round(F.avg("degree"), 6).alias("average_degree"))
    one = parts.crossJoin(other).crossJoin(mean)  # single rows
    return one.select("n_components", (F.col("n_components") == 1).alias("connected"), "average_clustering", "average_degree")


def integrity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether masks cover every vertex once and edges stay within the indices (vertices: idx, is_train, is_test)."""
    v = vertices.agg(F.count("*").alias("n"), F.count_if(F.col("is_train") != F.col("is_test")).alias("covered"), F.max("idx").alias("top"))
    e = edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.max(F.greatest("src_idx", "dst_idx")), F.lit(-1)).alias("max_edge"))
    return v.crossJoin(e).select("n", "n_edges", (F.col("covered") == F.col("n")).alias("masks_cover"), (F.col("max_edge") < F.col("n")).alias("edges_inside"), (F.col("top") + 1 == F.col("n")).alias("index_gapless"))


def numeric_order(df: DataFrame, key: str = "tweet_id") -> DataFrame:
    """``df`` sorted by the number that its key spells, then by the key; keys that are no number come last."""
    number = F.expr(f"try_cast(`{key}` AS DECIMAL(38, 0))")
    return df.orderBy(number.asc_nulls_last(), key)


def graph_metadata(vertices: DataFrame, columns: list[str], labels: dict[str, int]) -> DataFrame:
    """One row that describes a graph: its size, its topics in order, feature columns and class numbers."""
    topics = F.array_sort(F.collect_set("topic"))
    return vertices.agg(F.count("*").alias("num_nodes"), topics.alias("topics")).withColumns({"feature_columns": F.array(*map(F.lit, columns)), "label_map": F.create_map(*[F.lit(x) for p in labels.items() for x in p])})
