"""Graphs as edge tables (src, dst): breadth-first search, triangles, cores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rounds import Steps, written


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse; repeated edges and loops stay."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours), multi-edges kept."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def default_source(edges: DataFrame) -> int | None:
    """The smallest vertex with an outgoing edge."""
    return edges.agg(F.min("src")).first()[0]


def bfs(edges: DataFrame, source: int, max_depth: int | None = None) -> DataFrame:
    """(v, level) of the vertices that a source reaches.

    A level's frontier is joined with the edges and loses what was seen before;
    the loop ends with an empty frontier.  Edges are reduced to distinct ones
    and written once; every level writes its frontier and all that was seen, as one
    table, so a plan holds one level whatever the depth.
    """
    spark = edges.sparkSession
    links = written(edges.select("src", "dst").where("src <> dst").distinct())
    seen = spark.createDataFrame([(source, 0)], "v long, level int")
    frontier, level = seen, 0
    while max_depth is None or level < max_depth:
        level += 1
        step = links.join(frontier.select(F.col("v").alias("src")), "src").select(F.col("dst").alias("v")).distinct()
        frontier = written(step.join(seen.select("v"), "v", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier))
    return seen


def bfs_bottom_up(edges: DataFrame, levels: DataFrame, level: int) -> DataFrame:
    """(v, level + 1) of the vertices without a level that have a neighbour in the given one: a semi join."""
    frontier = levels.where(F.col("level") == level).select(F.col("v").alias("dst"))
    near = edges.join(frontier, "dst", "left_semi").select(F.col("src").alias("v")).distinct()
    return near.join(levels.select("v"), "v", "left_anti").withColumn("level", F.lit(level + 1))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, each once as (u < v)."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


#: Out-going edges of a vertex that are sent as one row.
HUB = 1000
#: Entries of lists that a round of ``triangles`` sends: as many, or so many an edge if that is more.
SENT, SENT_AN_EDGE = 100_000_000, 3


def _arcs(edges: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(a, out): the ends of the edges out of each vertex, where an edge points to its end of the higher degree; (x, d): degrees."""
    links = steps.save(simple(edges), "links")
    degree = steps.save(links.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("d")), "degree")
    # the edges needn't be sorted, which would spill
    at = lambda end: degree.select(F.col("x").alias(end), F.col("d").alias(f"d{end}")).hint("shuffle_hash")
    half = steps.save(links.join(at("u"), "u"), "half")
    steps.drop("links")
    up = F.struct("du", "u") < F.struct("dv", "v")
    arcs = steps.save(half.join(at("v"), "v").select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b")), "arcs")
    steps.drop("half")
    # dealt as edges: lists begun before the shuffle would hold one each
    out = steps.save(arcs.repartition("a").groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("out")), "out")
    steps.drop("arcs")
    return out, degree


def _closed(out: DataFrame, own: DataFrame, hub: int) -> DataFrame:
    """(v, n): of the triangles whose first vertex is one of ``own``, which is a part of ``out``."""
    part = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("out") - 1) / hub).cast("int")), lambda i: F.slice("out", i * hub + 1, hub)))
    lists = out.select(F.col("a").alias("b"), part.alias("no", "sent")).drop("no")
    # the lists' receivers needn't be sorted, which would spill
    sent = own.select("a", F.explode("out").alias("b")).join(lists.hint("shuffle_hash"), "b")
    closed = sent.join(own.hint("shuffle_hash"), "a").select("a", "b", F.array_intersect("sent", "out").alias("cs"))
    ends_of = lambda v, n: F.struct(v.alias("v"), n.cast("long").alias("n"))
    size = F.size("cs")
    each = F.concat(F.array(ends_of(F.col("a"), size), ends_of(F.col("b"), size)), F.transform("cs", lambda c: ends_of(c, F.lit(1))))
    return closed.where(size > 0).select(F.explode(each).alias("e")).groupBy("e.v").agg(F.sum("e.n").alias("n"))


def triangles(edges: DataFrame, hub: int = HUB, most: int = SENT) -> DataFrame:
    """(v, n): in how many triangles each vertex is that is in any.

    Edges point to the end of the higher degree (of equal ones, the larger
    number), so no vertex has more than the root of twice the edges of them, and
    each triangle is one a -> b, a -> c with an edge b -> c.  Wedges are never
    rows: the edges out of b are sent along a -> b as lists of at most ``hub``, and are
    cut there with those out of a.  A b without edges of its own sends nothing.

    What all lists sent have is counted first.  If it is more than ``most`` and than
    ``SENT_AN_EDGE`` for each edge, the receivers take turns in as many rounds as it takes, and a
    round's counts are written before the next, so the disk holds a bounded part of it.
    """
    steps = Steps(edges.sparkSession, "triangles")
    out, degree = _arcs(edges, steps)
    n, d = F.col("n"), F.col("d")
    all_sent, m = out.select(F.col("a").alias("x"), F.size("out").cast("long").alias("n")).join(degree.hint("shuffle_hash"), "x").agg(F.sum(n * (d - n)), F.sum(n)).first()
    steps.drop("degree")
    rounds = -(-(all_sent or 0) // max(most, SENT_AN_EDGE * (m or 0)))
    if rounds <= 1:
        return _closed(out, out, hub)
    turn = F.pmod(F.xxhash64("a"), F.lit(rounds))
    parts = [steps.save(_closed(out, out.where(turn == i), hub), f"counts{i}") for i in range(rounds)]
    steps.drop("out")
    return reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.sum("n").alias("n"))


#: Neighbours of a vertex in a row of the lists of ``core_numbers``.
LIST = 10_000


def _neighbour_lists(links: DataFrame, degree: DataFrame, size: int) -> DataFrame:
    """(src, to, deg): each vertex's neighbours and their degrees, the highest first, in rows of about ``size``, dealt by src."""
    # the edges needn't be sorted, which would spill
    ends = links.join(degree.select(F.col("v").alias("u"), F.col("core").alias("du")).hint("shuffle_hash"), "u").join(degree.select("v", F.col("core").alias("dv")).hint("shuffle_hash"), "v")
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(f"d{a}").alias("d"), F.struct(F.col(f"d{b}").alias("d"), F.col(b).alias("to")).alias("x"))
    both = ends.select(F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e")).select("e.*")
    part = F.pmod(F.xxhash64("x.to"), F.ceil(F.col("d") / size))
    dealt = both.select("src", "x", part.alias("part")).repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")
    lists = dealt.groupBy("src", "part").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"))
    return lists.select("src", F.col("xs.to").alias("to"), F.col("xs.d").alias("deg"))


def core_numbers(edges: DataFrame, max_rounds: int | None = None, size: int = LIST) -> DataFrame:
    """(v, core): the largest k such that the vertex lies in a subgraph where all have k neighbours or more.

    Each vertex holds a bound, at first its degree.  A round lowers it to the
    largest k such that k neighbours have a bound of k or more; the bounds that no round lowers
    are the core numbers (peeling from all sides at once).  A vertex keeps how many
    neighbours have which bound, cut at its own; at first it takes all for as good as
    itself.  So only a bound that was lowered is sent, and only to neighbours
    of a higher degree, as to others it is as good as before.  What is sent is
    counted before it is shuffled, so a hub's rows in a task are as many as
    different bounds.  Every round is written.  Vertices without neighbours aren't there.
    """
    links = written(simple(edges))
    degree = written(links.select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count("*").alias("core")))
    lists = written(_neighbour_lists(links, degree, size))
    state = degree.select("v", "core", F.col("core").alias("k"), F.col("core").alias("n"))
    lowered = degree.select(F.col("v").alias("src"), F.lit((1 << 63) - 1).alias("old"), F.col("core").alias("new"))
    of_all, from_top = Window.partitionBy("v"), Window.partitionBy("v").orderBy(F.desc("k"))
    count = lambda k, n: F.struct(F.col(k).alias("k"), n.alias("n"))
    done = 0
    while max_rounds is None or done < max_rounds:
        done += 1
        higher = F.expr("slice(to, 1, size(filter(deg, d -> d > new)))")
        sent = lists.join(lowered, "src").select(F.explode(higher).alias("v"), "old", "new").groupBy("v", "old", "new").agg(F.count("*").alias("n"))
        news = sent.select("v", F.lit(None).cast("long").alias("core"), F.explode(F.array(count("old", -F.col("n")), count("new", F.col("n")))).alias("x")).select("v", "core", "x.*")
        known = state.select("v", "core", "k", "n").unionByName(news).withColumn("core", F.max("core").over(of_all))
        counts = known.groupBy("v", "core", F.least("k", "core").alias("k")).agg(F.sum("n").alias("n")).where("n <> 0").withColumn("at_least", F.sum("n").over(from_top))
        fresh = counts.withColumn("new", F.max(F.least("k", "at_least")).over(of_all))
        state = written(fresh.select("v", F.col("core").alias("old"), F.col("new").alias("core"), F.least("k", "new").alias("k"), "n"))
        lowered = state.where("core < old").select(F.col("v").alias("src"), "old", F.col("core").alias("new")).distinct()
        if lowered.isEmpty():
            break
    return state.select("v", "core").distinct()
