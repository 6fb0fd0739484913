"""Splits that keep related records together: components by a frontier search from many seeds.

Adjacency is kept hash-partitioned by node. Nodes that come first among their neighbours, in
hash order, are seeds; every component has at least one. All seeds expand at once, a frontier at
a time, and each node takes the label of the seed that reaches it. Where two seeds meet, their
labels collide: the collisions are the edges of a much smaller graph, on which the search runs
again, or which one task solves once it is proven small. A component's name is its least node
hash, and components go to splits in hash order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.text import collapse_ws, strip_ws
from siltwork.session import bounded_broadcast, checkpointed

_MAX_LEVELS = 60
_BINS = 4096


def user_key(c: Column) -> Column:
    """A user id for comparison: trimmed and lower-cased; null where empty."""
    key = F.lower(strip_ws(c))
    return F.when(key != "", key)


def text_key(c: Column) -> Column:
    """Digest of a text for comparison: trimmed, white space runs as one space, lower case."""
    return F.md5(F.lower(collapse_ws(c)))


def _hash(c: Column) -> Column:
    """Order of nodes: 64 hash bits and then the name, so that it is total and free of chance ties."""
    return F.concat(F.hex(F.xxhash64(c)), F.lit(":"), c)


def components(edges: DataFrame, *, small: int = 200_000) -> DataFrame:
    """``node``, ``component`` for every end of the undirected ``edges`` (``a``, ``b`` strings).

    The component's name is a digest of its first node in hash order. Edges with a null end are no edges;
    loops and repeated edges change nothing; an empty table gives an empty table. The search goes on
    until no node is left. A graph of collided labels with at most ``small`` edges is solved in
    one task; frontiers up to ``small`` nodes are broadcast.
    """
    named = edges.where("a IS NOT NULL AND b IS NOT NULL").select(_hash(F.col("a")).alias("a"), _hash(F.col("b")).alias("b"))
    labels = _labelled(named, 0, small)
    return labels.select(
        F.expr("substring(node, length(substring_index(node, ':', 1)) + 2)").alias("node"), F.md5("label").alias("component")
    )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node``, ``label`` (the least node of its component) of all edges of one task."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([find(x) for x in nodes], pa.string())], names=["node", "label"])


def _labelled(edges: DataFrame, level: int, small: int) -> DataFrame:
    """``node``, ``label``: the least node of its component."""
    if level > _MAX_LEVELS:
        raise RuntimeError("components: the graph of labels doesn't shrink")
    if level and edges.limit(small + 1).count() <= small:
        return checkpointed(edges.select("a", "b").coalesce(1).mapInArrow(_united, "node string, label string"))
    both = checkpointed(edges.union(edges.select("b", "a")).distinct())
    # Seeds: nodes without a smaller neighbour (nodes with loops only are seeds as well).
    least = both.groupBy("a").agg(F.min("b").alias("b"))
    labelled = checkpointed(least.where("a <= b").select(F.col("a").alias("node"), F.col("a").alias("label")))
    out, frontier, hops = labelled, labelled, 0
    links = both.where("a <> b")
    while True:
        # A hot node's edges spread over tasks: the frontier is broadcast where it is small, and
        # skewed partitions of the shuffled join are split at run time where it is not.
        met = links.join(bounded_broadcast(frontier.select(F.col("node").alias("a"), "label"), small), "a")
        fresh = checkpointed(met.groupBy(F.col("b").alias("node")).agg(F.min("label").alias("label")))
        # Only what was reached just now is looked up among the nodes reached before.
        known = out.join(bounded_broadcast(fresh.select("node"), small), "node", "left_semi").select("node")
        frontier = checkpointed(fresh.join(bounded_broadcast(checkpointed(known), small), "node", "left_anti"))
        if frontier.isEmpty():
            break
        out, hops = out.unionByName(frontier), hops + 1
        if hops % 8 == 0:
            out = checkpointed(out)
    named = bounded_broadcast(out, small)
    ends = links.where("a < b").join(named.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(named.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    collisions = checkpointed(
        ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    )
    if collisions.isEmpty():
        return out
    merged = _labelled(collisions, level + 1, small).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return out.join(bounded_broadcast(merged, small), "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def relations(
    records: DataFrame, augmented: DataFrame, *, user_col: str = "user_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, users by text, and the node of each augmented text that some record bears.

    Nodes are ``u`` + user and ``g`` + the least augmentation row of a text. Texts without any
    record tie nothing.
    """
    rows = augmented.select(
        F.col("aug_id").cast("string").alias("aug"),
        F.explode(F.array_distinct(F.concat(F.array("original_text"), F.coalesce("variants", F.array().cast("array<string>"))))).alias("t"),
    ).where("t IS NOT NULL")
    texts = rows.select("aug", text_key(F.col("t")).alias("key")).distinct()
    borne = records.select(text_key(F.col(f"`{text_col}`")).alias("key"), user_key(F.col(f"`{user_col}`")).alias("user")).where("key IS NOT NULL")
    # Most records bear no augmented text: they leave before anything is shuffled, if the texts are few.
    borne = checkpointed(borne.join(bounded_broadcast(checkpointed(texts.select("key").distinct())), "key", "left_semi").distinct())
    texts = texts.join(borne.select("key").distinct(), "key", "left_semi")
    home = checkpointed(texts.groupBy("key").agg(F.min("aug").alias("home")))
    group = lambda c: F.concat(F.lit("g"), F.col(c))
    shared = texts.join(home, "key").select(group("home").alias("a"), group("aug").alias("b"))
    used = borne.where("user IS NOT NULL").join(home, "key").select(F.concat(F.lit("u"), "user").alias("a"), group("home").alias("b"))
    return shared.union(used).distinct(), borne, home.select("key", group("home").alias("node"))


def user_groups(records: DataFrame, augmented: DataFrame) -> DataFrame:
    """``user``, ``component``: users that some augmented text ties, with their group.

    Users are compared trimmed and lower-cased; null and empty ones tie nothing. An augmentation
    row without variants, a failed one and a repeated one are taken by the texts they have.
    Empty tables give an empty table.
    """
    edges, _, _ = relations(records, augmented)
    return components(edges).where("node LIKE 'u%'").select(F.expr("substring(node, 2)").alias("user"), "component")


def related_users(records: DataFrame, augmented: DataFrame, *, part: int = 1000) -> DataFrame:
    """``user_a`` < ``user_b``: users whose records have to land in one split, as pairs. The rows are
    as many as the pairs of every group; ``user_groups`` has one row a user.

    A group of more than ``part`` users is split among tasks: each takes ``part`` of its users
    against all. The cases are those of ``user_groups``.
    """
    users = checkpointed(user_groups(records, augmented))
    sizes = users.groupBy("component").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    users = checkpointed(users.join(bounded_broadcast(sizes), "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    a = users.select("component", F.col("user").alias("user_a"), F.pmod(F.xxhash64("user"), F.col("parts").cast("long")).alias("part"))
    b = users.select("component", F.col("user").alias("user_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    return a.join(b, ["component", "part"]).where("user_a < user_b").select("user_a", "user_b")


def grouped_split(
    records: DataFrame, augmented: DataFrame, labels: DataFrame, *, proportions: dict[str, float],
    id_col: str = "row_id", classes: tuple[str, ...] = (), seed: int = 42, heavy_share: int = 1000,
) -> DataFrame:
    """``row_id``, ``group``, ``split``: proportions of the records, no group divided.

    ``labels`` has ``row_id`` and ``label`` (one row for a record; absent ones count as none).
    Groups with more than one in ``heavy_share`` of all records, of which there can be at most
    ``heavy_share``, are placed first, largest first, each where it keeps the class mix closest
    to the proportions. The rest, in hash order, fill what is left of every split, exact to about
    one in 4096 rows or a group.

    Cases: a record that nothing ties is a group of its own; null ids and repeated rows are kept;
    an empty table gives an empty table; proportions must be positive and are scaled to sum 1.
    """
    if not proportions or min(proportions.values()) <= 0:
        raise ValueError("proportions must be positive")
    total = sum(proportions.values())
    names = list(proportions)
    share = {k: v / total for k, v in proportions.items()}
    edges, _, home = relations(records, augmented)
    comp = checkpointed(components(edges))
    rec = records.select(
        F.col(f"`{id_col}`").alias("id"), user_key(F.col("user_id")).alias("user"), text_key(F.col("text")).alias("key")
    )
    by_user = comp.where("node LIKE 'u%'").select(F.expr("substring(node, 2)").alias("user"), F.col("component").alias("cu"))
    by_text = home.join(comp, "node").select("key", F.col("component").alias("ct"))
    # A hot user is one key of a small side: broadcast where proven small, else AQE splits it.
    rec = rec.join(bounded_broadcast(by_user), "user", "left").join(bounded_broadcast(by_text), "key", "left")
    own = F.concat(F.lit("r"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rec = rec.select("id", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("cu", "ct", F.concat(F.lit("u"), "user"), own))).alias("group"))
    lab = labels.select(F.col("row_id").alias("id"), "label")
    rec = checkpointed(rec.join(lab, "id", "left"))
    kinds = list(classes) or ["any"]
    hit = lambda k: F.col("label") == k if classes else F.lit(True)
    sizes = checkpointed(
        rec.groupBy("group").agg(F.count("*").alias("n"), *[F.count_if(hit(k)).alias(f"c{i}") for i, k in enumerate(kinds)])
    )
    cols = ["n", *[f"c{i}" for i in range(len(kinds))]]
    whole = [x or 0 for x in sizes.agg(*[F.sum(c) for c in cols]).first()]
    heavy = sizes.where(F.col("n") > max(1, whole[0] // heavy_share)).orderBy(F.desc("n"), "group").collect()
    have = {k: [0.0] * len(cols) for k in names}
    placed = {}
    for row in heavy:
        def cost(k: str, row=row) -> float:
            over = [(have[k][i] + row[c]) / max(1.0, whole[i]) / share[k] for i, c in enumerate(cols) if row[c]]
            return max(over)

        best = min(names, key=cost)
        placed[row["group"]] = best
        have[best] = [h + row[c] for h, c in zip(have[best], cols)]
    left = [max(0.0, share[k] * whole[0] - have[k][0]) for k in names]
    # The light groups in hash order, cut where the counts reach what is left of each split: exact
    # to one of `_BINS` stretches of the order, whose counts are all that reaches the driver.
    unit = F.conv(F.substring("group", 1, 12), 16, 10).cast("double") / float(16**12)
    light_sizes = sizes.where(F.col("n") <= max(1, whole[0] // heavy_share))
    found = {r["bin"]: r["n"] for r in light_sizes.groupBy(F.floor(unit * _BINS).cast("int").alias("bin")).agg(F.sum("n").alias("n")).collect()}
    reached = list(itertools.accumulate((found.get(i, 0) for i in range(_BINS)), initial=0))
    room, at, light = sum(left) or 1.0, 1.0, F.lit(names[-1])
    for k, x in zip(reversed(names[:-1]), reversed(left[1:])):
        at -= x / room
        edge = min(range(_BINS + 1), key=lambda i: (abs(reached[i] - at * reached[-1]), i))  # noqa: B023
        light = F.when(unit < edge / _BINS, k).otherwise(light)
    if placed:
        given = rec.sparkSession.createDataFrame(list(placed.items()), "group string, placed string")  # at most heavy_share rows
        rec = rec.join(F.broadcast(given), "group", "left")
        light = F.coalesce("placed", light)
    return rec.select(F.col("id").alias(id_col), "group", light.alias("split"))
