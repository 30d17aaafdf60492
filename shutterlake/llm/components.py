"""One group for everything that hangs together.

Connected components by low-diameter decomposition: every vertex starts to grow
a cluster at a time shifted by an exponential variable, each vertex joins the
cluster that reaches it first, clusters contract to super-vertices, and the
edges between clusters are decomposed again. The edges shrink by a factor each
level, whatever the diameter, so a chain of millions takes some dozen levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.digests import bits_apart
from shutterlake.operators.skew import hot_keys, salted_join
from shutterlake.sources.tables import discard, materialize


#: Edges of a vertex, or rows of a key, beyond which it is dealt over tasks.
ROWS_PER_SALT = 20_000


def _edges(df: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller end first, without loops and null ends."""
    return df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _hot(both: DataFrame, count: int) -> DataFrame | None:
    """Hubs: vertices with very many edges (u), null if there are none."""
    return hot_keys(both.select("u"), ["u"], ROWS_PER_SALT) if count > ROWS_PER_SALT else None


def _clusters(edges: DataFrame, hot: DataFrame | None, level: int, beta: float, rounds: int) -> DataFrame:
    """(node, cluster): one decomposition. Reaching a vertex later than ``rounds`` steps doesn't count; it then keeps the best cluster so far, which is connected to it all the same."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    chance = (F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    state = nodes.select("node", F.struct((F.log(chance) / beta).alias("at"), F.col("node").alias("cluster")).alias("best"))
    for _ in range(rounds):
        told = salted_join(state.withColumnRenamed("node", "u"), both, ["u"], ROWS_PER_SALT, hot=hot)
        told = told.select(F.col("v").alias("node"), F.struct((F.col("best.at") + 1).alias("at"), F.col("best.cluster").alias("cluster")).alias("best"))
        state = state.unionByName(told).groupBy("node").agg(F.min("best").alias("best"))
    return state.select("node", F.col("best.cluster").alias("cluster"))


def components(edges: DataFrame, beta: float = 0.25, rounds: int = 3, sizes: list[int] | None = None) -> DataFrame:
    """(node, group): every vertex of ``edges`` (u, v bigint) with the smallest vertex it is linked to, directly or through others.

    Loops, repeated and reversed edges and null ends are harmless; without
    edges the result is empty. The recursion ends when no edge is left. Every
    level is written to the shared folder, so a lost executor costs one level;
    ``sizes``, if given, receives the edges of each level. Edges of a hub and
    vertices of a giant cluster are dealt over tasks.
    """
    left = materialize(_edges(edges), "edges")
    maps: list[DataFrame] = []
    while count := left.count():
        if sizes is not None:
            sizes.append(count)
        level = len(maps)
        hot = _hot(left.select("u").unionByName(left.select(F.col("v").alias("u"))), count)
        found = materialize(_clusters(left, hot, level, beta, rounds), f"clusters-{level}")
        maps.append(found)
        of = lambda end: found.select(F.col("node").alias(end), F.col("cluster").alias(f"c{end}"))  # noqa: B023, E731
        rest = salted_join(of("u"), left, ["u"], ROWS_PER_SALT, hot=hot)
        rest = salted_join(of("v"), rest, ["v"], ROWS_PER_SALT, hot=hot.withColumnRenamed("u", "v") if hot is not None else None)
        smaller = materialize(_edges(rest.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), f"edges-{level}")
        discard(left)
        left = smaller
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("group"))
    final = maps[-1]
    for found in reversed(maps[:-1]):
        later = final.select(F.col("node").alias("cluster"), F.col("cluster").alias("root"))
        final = materialize(salted_join(later, found, ["cluster"], ROWS_PER_SALT, how="right").select("node", F.coalesce("root", "cluster").alias("cluster")), "roots")
    names = final.groupBy("cluster").agg(F.min("node").alias("group"))
    return salted_join(names, final, ["cluster"], ROWS_PER_SALT).select("node", "group")


def star_edges(df: DataFrame, key: list[str], node: str = "node") -> DataFrame:
    """(u, v): each node with the smallest of its key; null keys link nothing. A hot key is a star, not a clique."""
    known = materialize(df.where(" and ".join(f"{k} is not null" for k in key)).select(*key, node), "star")
    hubs = known.groupBy(*key).agg(F.min(node).alias("u"), F.max(node).alias("_last")).where("u <> _last").drop("_last")
    return salted_join(hubs, known.withColumnRenamed(node, "v"), key).where("u <> v").select("u", "v")


def close_hashes(df: DataFrame, hash_column: str, node: str, most: int = 2) -> DataFrame:
    """(u, v): one node of each two distinct hashes that differ in 1 to ``most`` bits.

    The 64 bits are cut into ``most + 2`` blocks; hashes that close agree in two
    of them, so pairs are looked up by every two blocks and then verified.
    """
    values = df.where(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).alias("h")).agg(F.min(node).alias("n"))
    n = most + 2
    cuts = [round(64 * k / n) for k in range(n + 1)]

    def mask(k: int) -> int:
        return ((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k]

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys: list[Column] = [F.struct(F.lit(i * n + j).alias("t"), F.col("h").bitwiseAND(F.lit(signed(mask(i) | mask(j)))).alias("b")) for i in range(n) for j in range(i + 1, n)]
    table = materialize(values.select("h", "n", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.b", "h", "n"), "hash-blocks")
    other = table.select("t", "b", F.col("h").alias("g"), F.col("n").alias("m"))
    pairs = salted_join(table, other, ["t", "b"], ROWS_PER_SALT).where((F.col("h") < F.col("g")) & (bits_apart(F.col("h"), F.col("g")) <= most))
    return pairs.select(F.col("n").alias("u"), F.col("m").alias("v")).distinct()
