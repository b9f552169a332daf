"""Links between items that share a band, and their connected components.

Nothing here collects a bucket, a component or a link to the driver or to one task, and no step makes all pairs of a large bucket.

1. Members of a bucket are verified against its most popular member (the one that shares most buckets with most others, so the middle of
   a group of near copies). What this links is one component, and pairs inside a component need no check any more.
2. Buckets that still hold several components but few pairs across them (at most FEW for each member) have all these pairs verified.
3. The others are refined. Each gets a center near its middle, and all members are compared with it. A member is then known by its differences: the
   shingles of the center that it lacks and those that it adds. Two facts about the similarity t = s(x, y) of sets (or of weighted sets)
   with weights C of the center, d lacked and a added, w = d + t * a, let pairs be found by their differences alone:
   - members linked to the center are one component;
   - if s(y, center) < t <= s(x, y), then x and y share differences of weight more than w(x) / (1 + t), and of at least w(x) - (1 - t) * C
     and w(y) - (1 - t) * C, for any x.
   So with the differences of a member in order of their frequency, all but an end of that weight (the prefix filter) must hold one that
   the two share. These differences are the new, much smaller buckets, and no link is lost. They go to step 2, and again to step 3.

After ROUNDS refinements, a further one follows only as long as the last one has at least halved the pairs of large buckets. Then the pairs
that are left are verified, whatever their number, so the components are always those of all candidate pairs.

Sketches (sketched_classes, and set_classes for plain sets) need no refinement: after step 1, the pairs of a bucket across components meet
as sketches of 64 * WORDS bits, and only pairs that these cannot tell apart are verified. A bit of a sketch is the parity of the elements
that fall on it, so two sketches differ in no more bits than the sets do in elements, and a pair that differs in too many has no similarity
of the threshold: no link is lost. Elements may have weights: each word then takes elements of a least weight only, its grade, and a bit
counts as much. Sketches are compared inside a join, in tiles of buckets, so a bucket is dealt to many tasks; this is quadratic in a bucket,
at some ten machine instructions a pair, but no row is made of a pair that sketches tell apart. Members of large buckets first meet some
PIVOTS members only. That makes most of a group of near copies one component, whose pairs need not meet and so make no rows either.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let

#: Refinements that are made in any case, and the pairs for each member up to which a bucket is compared as it is.
ROUNDS, FEW = 3, 4
MAX_STEPS = 60
#: Rows that a partition of a table of ids, keys or links should hold at least.
DENSE = 50_000


def dense(df: DataFrame) -> DataFrame:
    """df, cut, with partitions joined to DENSE rows at least: small tables take few tasks, and the smallest no shuffle."""
    df = cut(df)
    return df.coalesce(df.count() // DENSE + 1)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the least id of its component.

    Alternating large-star and small-star steps, each a group-by with partial aggregation and a join, cut by a checkpoint. Self-links
    and repeated links are allowed; no links give no rows. Partitions are joined as the edges shrink, so that small graphs take few tasks.
    """

    def each(df: DataFrame, *rows: tuple) -> DataFrame:
        # no union, as that would shuffle a single partition
        return df.select(F.inline(F.array(*[F.struct(F.expr(u).alias("u"), F.expr(v).alias("v")) for u, v in rows])))

    def state(df: DataFrame) -> tuple:
        """The edges, and the ids that are neither the center of a star nor a leaf of one."""
        ends = each(df, ("u", "1"), ("v", "0")).groupBy("u").agg(F.sum("v").alias("up"), F.min("v").alias("least"))
        return ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 or up = 1 and least = 0"))).first()

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(MAX_STEPS):
        rows, others = state(edges)
        edges = edges.coalesce((rows or 0) // DENSE + 1)
        # each component is the star of its least id
        if not others:
            break
        both = each(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = each(large.join(down, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()
        edges = cut(small)
    else:
        raise RuntimeError("components did not settle")
    return each(edges, ("u", "v"), ("v", "v")).distinct().toDF("id", "root")


#: Bits of the map that thins out rows before a join; its size does not depend on the tables.
BITS = 1 << 24


def among(rows: DataFrame, col: str, wanted: DataFrame, by: str) -> DataFrame:
    """The rows whose hash in col may be among those of wanted[by] (all that are, and few others); a join has still to follow."""
    return sifted(rows, col, wanted, by)[0]


def sifted(rows: DataFrame, col: str, wanted: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """What among gives, and all other rows.

    The bits of wanted are set in a map of BITS bits, one row of BITS / 64 numbers, which every task gets. Where wanted has so many rows
    that most bits are set, most rows pass; the join is right all the same.
    """
    at = lambda c: F.col(c).bitwiseAND(F.lit(BITS - 1))
    words = wanted.select(at(by).alias("b")).select(F.expr("b div 64").cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    slots = rows.sparkSession.range(0, BITS // 64, 1, 1).select(F.col("id").cast("int").alias("w"))
    full = slots.join(words, "w", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m")))), lambda x: x["m"]).alias("_map"))
    hit = F.expr(f"(element_at(_map, cast(({col} & {BITS - 1}) div 64 as int) + 1) & shiftleft(1L, cast(({col} & 63) as int))) <> 0")
    full = F.broadcast(cut(full))
    return rows.join(full, hit, "left_semi"), rows.join(full, hit, "left_anti")


def placed(contents: DataFrame) -> DataFrame:
    """contents (id, ...), cut, and dealt and sorted by id once, so that the joins of with_contents leave them where they are."""
    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(contents.repartition(n, "id").sortWithinPartitions("id"))


def with_contents(pairs: DataFrame, contents: DataFrame, col: str) -> DataFrame:
    """pairs (a, b) with x and y, the col of contents (id, col) for a and b. Contents that are placed are not shuffled; x is, once for each pair."""
    sides = pairs.join(contents.select(F.col("id").alias("a"), F.col(col).alias("x")), "a")
    return sides.join(contents.select(F.col("id").alias("b"), F.col(col).alias("y")), "b")


def contrast_sets(sides: DataFrame, x: Column, y: Column, threshold: float) -> DataFrame:
    """A contrast (see link_classes) of pairs (a, b) with sets x and y, arrays without repeated elements of type long."""
    # a generator evaluates the sets once; a and b go through it too, as constraints on them do not outlive a checkpoint and a union
    both = F.array(F.struct("a", "b", x.alias("x"), y.alias("y")))
    parts = sides.select(F.inline(F.transform(both, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_except(s["x"], s["y"]).alias("less"), F.array_except(s["y"], s["x"]).alias("more"), F.size(s["x"]).alias("n")))))
    d, a, n = F.size("less"), F.size("more"), F.col("n")
    return parts.select(
        "a", "b", ((n - d >= threshold * (n + a)) & (n > d)).alias("linked"), (d + threshold * a).cast("double").alias("w"), n.cast("double").alias("whole"),
        F.concat("less", "more").alias("tokens"), F.array_repeat(F.lit(1.0), d + a).alias("weights"),
    )


def alike_sets(x: Column, y: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two such sets is threshold or more; each is evaluated once."""
    enough = lambda s, n: (n > 0) & (n >= threshold * (F.size(s["x"]) + F.size(s["y"]) - n))
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: let(F.size(F.array_intersect(s["x"], s["y"])), lambda n: enough(s, n)))


def shared_buckets(bands: DataFrame) -> DataFrame:
    """bands (key, id) without repeated rows and without keys of a single id, with n: the ids of the key. One shuffle for counts, and a small one for what may have a common key."""
    several = dense(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return among(bands, "key", several, "key").join(several, "key")


#: Words of 64 bits in a sketch, and members that a tile of a bucket has on average.
WORDS, TILE = 16, 1000
#: Members of a bucket from which on it meets some of them first, and how many of them.
LARGE, PIVOTS = 300, 16


def sketches(sets: DataFrame) -> DataFrame:
    """(id, n, w0, w1, …) of sets (id, s): the size of s, an array without repeated elements, and for each of 64 * WORDS bits the parity of the elements on it."""
    h = sets.select("id", F.explode("s").alias("v")).select("id", F.xxhash64("v").alias("h"))
    spots = h.select("id", F.expr(f"pmod(shiftright(h, 6), {WORDS})").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    return spots.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.when(F.col("w") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(WORDS)])


def _near(members: DataFrame, threshold: float, grades: Sequence[float], pivots: bool = False) -> DataFrame:
    """(a, b, far, root_a, root_b) of the pairs a < b of one key and two roots whose sketches allow a similarity of threshold; far is 1 where they hardly do.

    members: (key, id, root, many: the members of the key, n, w0, w1, …). pivots: of large buckets, and only pairs with one of some PIVOTS members.
    """
    words = [f"w{j}" for j in range(WORDS)]
    # tiles of members, which pivots are few beside
    dealt = members.withColumn("tiles", F.expr(f"cast(ceil(many / {TILE}) as int)")).withColumn("tile", F.expr("cast(pmod(xxhash64(id), tiles) as int)"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    if pivots:
        dealt = dealt.where(f"many > {LARGE}")
        sides = dealt.withColumn("lo", F.col("tile")), dealt.where(f"pmod(xxhash64(id, 7), many) < {PIVOTS}").withColumn("lo", every)
        once, keys = "x_id <> y_id", ["key", "lo"]
    else:
        # a tile meets itself and each other one
        dealt = dealt.select("*", every.alias("other")).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
        sides = dealt, dealt
        once, keys = "x_id < y_id and (lo = hi or x_tile <> y_tile)", ["key", "lo", "hi"]
    # a single partition would make all pairs in one task
    half = lambda side, x: side.repartition(*keys).select(*keys, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "root", "tile", "n", *words)])
    # sets of similarity t differ in no more than (1 - t) / (1 + t) of their sizes' sum
    most = f"((x_n + y_n) * {(1 - threshold) / (1 + threshold) + 1e-6!r}D + 1e-6D)"
    by_grade = {g: " + ".join(f"bit_count(x_{w} ^ y_{w})" for w, at in zip(words, grades, strict=True) if at == g) for g in dict.fromkeys(grades)}
    unlike = " + ".join(f"{float(g)!r}D * ({bits})" for g, bits in by_grade.items())
    met = f"{once} and x_root <> y_root and abs(x_n - y_n) <= {most} and {unlike} <= {most}"
    pairs = half(sides[0], "x").join(half(sides[1], "y"), keys).where(met)
    pairs = pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.expr(f"({unlike}) / {most}").alias("far"), F.expr("if(x_id < y_id, x_root, y_root)").alias("root_a"), F.expr("if(x_id < y_id, y_root, x_root)").alias("root_b"))
    return pairs.groupBy("a", "b").agg(F.min("far").alias("far"), F.first("root_a").alias("root_a"), F.first("root_b").alias("root_b"))


def _nearest(near: DataFrame, *by: str) -> DataFrame:
    """Pairs of each member with the one nearest to it, by the other columns named."""
    flip = {"a": "b", "b": "a", "root_a": "root_b", "root_b": "root_a"}
    ends = near.unionByName(near.select(*[F.col(flip.get(c, c)).alias(c) for c in near.columns]))
    best = ends.groupBy("a", *by).agg(F.min(F.struct("far", "b"))["b"].alias("y"))
    return _pairs(best.select(F.col("a").alias("x"), "y"))


def set_classes(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], contents: DataFrame, elements: Column, threshold: float) -> DataFrame:
    """(id, root) as link_classes gives them, for sets: elements of contents (id, ...) is an array of type long without repeated elements."""

    def marked(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        return rows.join(sketches(contents.join(rows.select("id").distinct(), "id", "left_semi").select("id", elements.alias("s"))), "id")

    return sketched_classes(buckets, verify, marked, threshold)


def sketched_classes(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], marked: Callable[[DataFrame], DataFrame], threshold: float, grades: Sequence[float] = (1.0,) * WORDS) -> DataFrame:
    """(id, root) as link_classes gives them, by sketches.

    marked adds (n, w0, w1, …) to rows (id, …): n is the sum of the weights of all elements, and wj the parities of elements that weigh
    grades[j] or more each. An element that stands k times is k elements.
    """
    rows, roots, _ = _met(buckets, verify)
    # a pivot has met all members of its bucket
    others = rows.where("id <> p").select("key", "id")

    def mixed(members: DataFrame) -> DataFrame:
        members = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = members.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return members.join(several.select("key", "many"), "key")

    left = cut(marked(mixed(others)))
    near = dense(_near(left, threshold, grades, pivots=True))
    if not near.isEmpty():
        roots = dense(_joined(roots, [dense(verify(_nearest(near, "root_b")))]))
        left = mixed(left.drop("root", "many"))
    near = dense(_near(left, threshold, grades))
    if near.isEmpty():
        return roots
    # each member with the one nearest to it first, so that most links of a group need not be verified
    roots = dense(_joined(roots, [dense(verify(_nearest(near)))]))
    name = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"now_{x}"))
    apart = dense(near.join(name("a"), "a", "left").join(name("b"), "b", "left").where("coalesce(now_a, a) <> coalesce(now_b, b)").select("a", "b"))
    return roots if apart.isEmpty() else dense(_joined(roots, [dense(verify(apart))]))


def _met(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, id, pop, p) with the most popular member p of each bucket, the (id, root) that links to these give, and (id, pop)."""
    rows = buckets.select("key", "id", "n")
    # an id has a few keys
    rows = dense(rows.select("key", "id", F.sum("n").over(Window.partitionBy("id")).alias("pop")))
    popular = rows.select("id", "pop").distinct()
    pivots = rows.groupBy("key").agg(F.max(F.struct("pop", "id"))["id"].alias("p"))
    rows = rows.join(pivots, "key")
    roots = components(dense(verify(_pairs(rows.select(F.col("id").alias("x"), F.col("p").alias("y"))))))
    return rows, dense(roots), popular


def link_classes(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], contrast: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(id, root) of the ids with a link, by the components of all verified candidate pairs.

    buckets: (key, id, n) as shared_buckets gives them. verify takes distinct pairs (a, b), a < b, and returns those that are links: the
    ones of similarity threshold or more. contrast takes distinct pairs (a, b) in any order and returns a row for each: (a, b, linked;
    tokens, weights: the differences of b from a with their weights; w, whole: w and C of the text above). A token stands for a shingle
    and the sign of the difference. Both may be called several times.
    """
    rows, roots, popular = _met(buckets, verify)
    # members of one side need not meet: here each is a side of its own
    rows = rows.withColumn("side", F.col("id"))
    before = float("inf")
    for step in count():
        labelled = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        whole = sizes.groupBy("key").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count(F.lit(1)).alias("roots"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        whole = whole.where("roots > 1 and lo <> hi")
        across = (F.col("all") * F.col("all") - F.col("squares")) / 2
        left = cut(labelled.join(whole.select("key", (across <= FEW * F.col("all")).alias("few"), (across / F.col("all")).alias("share")), "key"))
        # two rows: the pairs across components of small buckets and of large ones
        there = {r["few"]: r["pairs"] for r in left.groupBy("few").agg(F.sum("share").alias("pairs")).collect()}
        if not there:
            break
        if False in there and step >= ROUNDS and there[False] > before / 2:
            there, left = {True: 0.0}, left.withColumn("few", F.lit(True))
        before = there.get(False, 0.0)
        links = []
        if True in there:
            # a bucket's first pivot has met all its members
            one = left.where("few and (p is null or id <> p)")
            half = lambda x: one.select("key", F.col("id").alias(x), F.col("root").alias(f"root_{x}"), F.col("side").alias(f"side_{x}"))
            pairs = half("x").join(half("y"), "key").where("x < y and root_x <> root_y and side_x <> side_y")
            links.append(cut(verify(_pairs(pairs))))
        if False in there:
            many = left.where("not few")
            compared, more = _contrasted(_centers(many, popular).select(F.col("c").alias("a"), F.col("id").alias("b")), contrast)
            links += more
        roots = cut(_joined(roots, links))
        if False not in there:
            break
        rows = cut(_refined(compared, roots, threshold))
    return roots


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _joined(roots: DataFrame, links: list[DataFrame]) -> DataFrame:
    """roots after further links, by the components of the roots that they join."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    name = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
    edges = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    new = components(edges).select(F.col("id").alias("old"), F.col("root").alias("to"))
    # ids that had no link so far have no row in roots
    return roots.join(new, F.col("root") == F.col("old"), "full_outer").select(F.coalesce("id", "old").alias("id"), F.coalesce("to", "root").alias("root"))


def _centers(rows: DataFrame, popular: DataFrame) -> DataFrame:
    """(c, id): each member of a bucket with its center, the most popular item that the bucket's most popular member meets in any bucket. So buckets of one group of copies share a center."""
    pivots = rows.select("key", "id").join(popular, "id").groupBy("key").agg(F.max(F.struct("pop", "id")).alias("best"))
    met = rows.select("key", "id").join(pivots, "key").groupBy("id").agg(F.max("best")["id"].alias("c"))
    centers = pivots.select("key", F.col("best.id").alias("id")).join(met, "id").select("key", "c")
    # a center that is no member is compared as well, as it may join the members
    return rows.select("key", "id").join(centers, "key").select("c", "id").distinct().where("c <> id")


def _contrasted(members: DataFrame, contrast: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """The contrast of members (a, b) with their center a, or with a better one, and the links met.

    Differences that most members share belong to the center. The member that has most of these and few others lies nearest to the middle
    of the group, and takes the center's place.
    """
    first = cut(contrast(members))
    spread = first.select("a", "b", F.explode(F.arrays_zip("tokens", "weights")).alias("z")).select("a", "b", "z.tokens", "z.weights")
    sizes = first.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    common = spread.groupBy("a", "tokens").agg(F.count(F.lit(1)).alias("df")).join(sizes, "a").where("2 * df > n + 1").select("a", "tokens", F.lit(-1).alias("sign"))
    far = spread.join(common, ["a", "tokens"], "left").groupBy("a", "b").agg(F.sum(F.col("weights") * F.coalesce("sign", F.lit(1))).alias("far"))
    better = cut(far.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).where("x.far < 0").select("a", F.col("x.b").alias("c")))
    rows = first.select("a", "b").unionByName(better.select("a", F.col("a").alias("b"))).join(better, "a")
    second = cut(contrast(rows.select(F.col("c").alias("a"), "b").where("a <> b").distinct()))
    return first.join(better, "a", "left_anti").unionByName(second), [x.where("linked").select("a", "b") for x in (first, second)]


def _refined(compared: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(key, id, p, side): buckets of the members that share a difference that the prefix filter keeps, of several components and sides."""
    name = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
    rows = compared.join(name("a"), "a", "left").join(name("b"), "b", "left").withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})
    several = rows.groupBy("a").agg(F.min("root_b").alias("lo"), F.max("root_b").alias("hi")).where("lo <> hi").select("a")
    rows = rows.join(several, "a")
    tiny = 1e-6 * F.greatest(F.col("whole"), F.lit(1.0))
    to_outer, to_any = F.col("w") / (1 + threshold) + tiny, F.col("w") - (1 - threshold) * F.col("whole") - tiny
    # kind 0: pairs of members that are both not linked to the center; kind 1: a linked one and one of another component
    kinds = F.array_compact(F.array(
        F.when(~F.col("linked"), F.struct(F.lit(0).alias("kind"), F.greatest(to_outer, to_any).alias("keep"))),
        F.when(F.col("linked"), F.struct(F.lit(1).alias("kind"), F.greatest(to_outer, to_any).alias("keep"))),
        F.when(~F.col("linked") & (F.col("root_a") != F.col("root_b")), F.struct(F.lit(1).alias("kind"), to_any.alias("keep"))),
    ))
    rows = rows.select("a", "b", "root_b", "linked", F.explode(kinds).alias("x"), F.arrays_zip("tokens", "weights").alias("z"))
    rows = rows.select("a", "b", F.col("root_b").alias("root"), "linked", "x.kind", "x.keep", F.explode("z").alias("z"))
    rows = rows.select(F.xxhash64("a", "kind", "z.tokens").alias("key"), "a", F.col("b").alias("id"), "kind", "keep", F.col("z.weights").alias("weight"), F.when(F.col("kind") == 0, F.col("root")).otherwise(F.col("linked").cast("long")).alias("label"))
    useful = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "df")
    # the weight of a difference and of all commoner ones
    end = Window.partitionBy("a", "id", "kind").orderBy(F.desc("df"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.join(useful, "key").withColumn("end", F.sum("weight").over(end)).where("end > keep")
    side = F.when(F.col("kind") == 0, F.col("id")).otherwise(F.col("label")).alias("side")
    return kept.select("key", "id", F.lit(None).cast("long").alias("p"), side)
