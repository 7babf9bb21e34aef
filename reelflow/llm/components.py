"""Connected components of near-duplicates from hash buckets, without listing a bucket's pairs.

Input: ids with their band keys, where ids that share a key are candidates, and
the full set behind each id. Two ids are linked where their sets' Jaccard
similarity is at least ``percent`` / 100.

1. A bucket's centre is the member that shares buckets with most others. Every
   other member is measured against it on the full sets: their sizes, what they
   have in common, and the member's rest, its elements that the centre lacks.
   That makes as many pairs as members. Links to centres give components.
2. Centres that turned out connected give way to one hub, the one that shares
   most buckets, and the members of all their buckets are measured against it
   where they were not. A member that is not in its hub's component is an outer
   one. Whatever links it to another member y of the hub that is not in its own
   component has to be found. The two have at most
       min(common(x), common(y)) + (elements that the rests of x and y share)
   elements in common. So only two kinds of pairs can be linked: those for which
   the first term alone is enough, found by an equi join on the hub and a band of
   set sizes, and those whose rests share as much as is needed, found by an equi
   join on the hub and the first elements of the rests, as many as make sure
   that such a pair meets; what their rests share is then counted.
3. The few pairs that pass are confirmed on the full sets and join up the rest.

So each candidate pair is measured, already connected, or ruled out by the bound:
nothing is lost, and no bucket is cut. All of it is joins and partial aggregates
on keys and ids, which Spark may split where one is hot; each step is a table in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import discard, written


def connected(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b).

    Alternates large-star and small-star steps; each keeps the components and lowers the neighbours, until
    nothing changes.  A round is an aggregate of minima per id and a join back.
    """
    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, round_ = state(edges), 0
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).where("u <> v").distinct())
        round_ += 1
        last, edges = edges, written(small, f"{name}-{round_}")
        discard(last)
        now = state(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("id"), "component").unionAll(
        stars.select(F.col("component").alias("id"), "component").distinct())


MEETS = 6                                               # elements in which the starts of two rests have to agree
SIZE_STEP = 1.05                                        # sets of sizes within this factor share a band of sizes


def size_band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(SIZE_STEP)))


def comparison(elements: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """``compare`` of link_components in SQL functions, where ``elements`` makes a set from its content, as an array of numbers."""
    def compare(pairs: DataFrame) -> DataFrame:
        return (pairs.select("id", "centre", elements(F.col("x")).alias("x"), elements(F.col("y")).alias("y"))
                .select("id", "centre", F.size("x").cast("bigint").alias("n"), F.size("y").cast("bigint").alias("n_centre"),
                        F.array_except("x", "y").alias("rest"))
                .withColumn("common", F.col("n") - F.size("rest")))

    return compare


def link_components(signatures: DataFrame, sets: DataFrame, compare: Callable[[DataFrame], DataFrame], percent: int, name: str,
                    close: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) for ids linked to another id.

    signatures: id (bigint) and band_keys (array<bigint>; null where a band does not apply). sets: id and ``content``,
    for every id that shares a key. compare: (id, centre, x, y), the contents of two sets, -> id, centre, n and n_centre
    (sizes), rest (array<bigint>, the elements of x that y lacks) and common (those it has), exactly. close: (a, b) ->
    the pairs that a cheaper estimate leaves; for those the full sets decide.
    """
    bands = signatures.select("id", F.explode("band_keys").alias("key")).where("key is not null").select("key", "id")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands = written(bands.join(shared, "key"), f"{name}-buckets")
    # only members of buckets are ever measured: their sets apart from the others
    sets = written(sets.join(bands.select("id").distinct(), "id", "left_semi"), f"{name}-members-sets")
    weight = bands.groupBy("id").agg(F.sum("size").alias("weight"))
    centre = (bands.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("top"))
              .select("key", F.col("top.id").alias("centre")))
    pairs = bands.join(centre, "key").where("id <> centre").select("id", "centre").distinct()
    own = sets.select("id", F.col("content").alias("x"))
    other = sets.select(F.col("id").alias("centre"), F.col("content").alias("y"))

    def measure(pairs: DataFrame) -> DataFrame:
        return compare(pairs.join(own, "id").join(other, "centre").select("id", "centre", "x", "y"))

    star = written(measure(pairs), f"{name}-star")
    near = F.expr(f"100 * common >= {percent} * (n + n_centre - common)")
    links = written(star.where(near).select(F.col("id").alias("a"), F.col("centre").alias("b")), f"{name}-links")
    parts = connected(links, f"{name}-first")

    def part(id_col: str, as_col: str) -> DataFrame:
        return parts.select(F.col("id").alias(id_col), F.col("component").alias(as_col))

    # one hub for all centres of a component; members of the hubs that have outer ones
    seen = (star.select("id", "centre").join(part("id", "part"), "id", "left").join(part("centre", "hub_part"), "centre", "left")
            .withColumns({"part": F.coalesce("part", "id"), "hub_part": F.coalesce("hub_part", "centre")}))
    hubs = (seen.select("centre", "hub_part").distinct().join(weight.withColumnRenamed("id", "centre"), "centre")
            .groupBy("hub_part").agg(F.max(F.struct("weight", "centre")).alias("top"))
            .select("hub_part", F.col("top.centre").alias("hub")))
    # only hubs with an outer member and a second member of another component have pairs to find
    members = seen.join(hubs, "hub_part").where("id <> hub").groupBy("hub", "hub_part", "id", "part").agg(
        F.bool_or(F.col("centre") == F.col("hub")).alias("known"))
    several = (members.groupBy("hub").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.bool_or(F.col("part") != F.col("hub_part")).alias("any"))
               .where("lo <> hi and any").select("hub"))
    members = written(members.join(several, "hub"), f"{name}-members")
    anew = measure(members.where("not known").select("id", F.col("hub").alias("centre")))
    both = star.unionAll(anew.select(*star.columns))
    marked = (members.join(both, (members["id"] == both["id"]) & (members["hub"] == both["centre"]))
              .select(members["hub"].alias("centre"), members["id"], "part", (F.col("part") != F.col("hub_part")).alias("outer"),
                      "n", "n_centre", "common", "rest"))
    marked = written(marked, f"{name}-open")
    discard(star, members)
    outer, total, whole = marked.where("outer"), 100 + percent, percent
    # a pair of two outer members comes once, from its larger id
    distinct_parts = F.expr("x.part <> y.part and (not y.outer or x.id > y.id)")
    most = F.floor(F.col("common") * total / whole) - F.col("n")           # sizes of y for which the common part may be enough
    least = F.ceil(F.col("n") * whole / 100)
    sized = (outer.select("centre", "id", "part", "n", "common", least.alias("least"), most.alias("most")).where("least <= most")
             .withColumn("band", F.explode(F.sequence(size_band(F.col("least")), size_band(F.col("most"))))).alias("x"))
    enough = (sized.join(marked.withColumn("band", size_band(F.col("n"))).alias("y"),
                         F.expr(f"x.centre = y.centre and x.band = y.band and y.n between x.least and x.most "
                                f"and {total} * y.common >= {whole} * (x.n + y.n)") & distinct_parts)
              .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    # a linked pair has at least ``percent`` of each set in common, so at least ``needed`` elements of each rest, so at least
    # ``meets`` = min(MEETS, needed) among the first (rest - needed + meets) of each in any common order
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * whole / 100) - F.col("common"))
    meets = F.least(F.lit(MEETS), needed).cast("int")
    first = F.slice(F.sort_array("rest"), F.lit(1), F.greatest(F.lit(0), F.size("rest") - needed + meets).cast("int"))
    held = (marked.select("centre", "id", "part", "outer", meets.alias("meets"), F.explode_outer(first).alias("element"))
            .where("element is not null").select(F.xxhash64("centre", "element").alias("spot"), "id", "part", "outer", "meets"))
    mixed = (held.groupBy("spot").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.bool_or("outer").alias("any"))
             .where("lo <> hi and any").select("spot"))
    held = held.join(mixed, "spot")
    meet = (held.where("outer").alias("x").join(held.alias("y"), F.expr("x.spot = y.spot") & distinct_parts)
            .groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.greatest("x.meets", "y.meets").alias("meets"))
            .agg(F.count("*").alias("times")).where("times >= meets").select("a", "b").distinct())
    # candidates share a key, their sizes fit, and the smaller rest, shared whole, is enough; only then are rests compared
    keys = bands.groupBy("id").agg(F.collect_set("key").alias("keys"))
    small = marked.select("centre", "id", "n", "common").join(keys, "id")

    def side(of: DataFrame, as_col: str) -> DataFrame:
        return of.select("centre", F.col("id").alias(as_col), F.struct(*[c for c in of.columns if c not in ("centre", "id")]).alias(f"of_{as_col}"))

    fit = (meet.join(side(small, "a"), "a").join(side(small, "b"), ["centre", "b"])
           .where(F.expr(f"100 * least(of_a.n, of_b.n) >= {whole} * greatest(of_a.n, of_b.n) and arrays_overlap(of_a.keys, of_b.keys) and "
                         f"{total} * (least(of_a.common, of_b.common) + least(of_a.n - of_a.common, of_b.n - of_b.common)) "
                         f">= {whole} * (of_a.n + of_b.n)")).select("centre", "a", "b"))
    full_side = marked.select("centre", "id", "n", "common", "rest")
    counted = (fit.join(side(full_side, "a"), ["centre", "a"]).join(side(full_side, "b"), ["centre", "b"])
               .withColumn("more", F.size(F.array_intersect("of_a.rest", "of_b.rest")).cast("bigint"))
               .where(f"{total} * (least(of_a.common, of_b.common) + more) >= {whole} * (of_a.n + of_b.n)").select("a", "b"))
    both = enough.unionAll(counted).distinct()
    if close is not None:
        both = close(both)
    full = measure(both.select(F.col("a").alias("id"), F.col("b").alias("centre")))
    more = written(full.where(near).select(F.col("id").alias("a"), F.col("centre").alias("b")), f"{name}-cross")
    to_hubs = marked.where("outer").where(near).select(F.col("id").alias("a"), F.col("centre").alias("b"))
    parts = connected(links.unionAll(to_hubs).unionAll(more), f"{name}-all")
    discard(bands, links, marked, more, sets)
    return parts
