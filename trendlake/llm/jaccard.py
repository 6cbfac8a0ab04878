"""Exact Jaccard join on word shingles, and the groups its links form.

Copies with equal shingle sets become one class first. Classes are joined by
prefixes: tokens are ordered rare ones first, and a prefix is long enough that
any partner within the threshold must share a signature with it. Rare tokens
are signatures by themselves. Frequent tokens (held by more than ``frequent``
classes' heads) are signatures only as pairs within small hash groups, for
which the prefix is extended by one token per group. Pairs that share a
signature are verified on their whole sets.

Links within a bucket are first sought with one leader, the member with the
most room for overlap; members already in one component are never compared
again. Members of different components under one leader are compared by what
tells them from it: few tokens, most of them rare. Pairs under different
leaders that share a signature are screened by their heads. What is left is
verified on whole sets, so no link is lost and no group is paired out.

The many tables in between are written in a number of files that follows the
size of the heads, not the number of shuffle partitions.
"""

from __future__ import annotations

import re
import sys
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.llm import words
from trendlake.llm.tables import discard, parts_for, written
from trendlake.operators.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(words)

FREQUENT = 64
#: Set sizes from which frequent tokens are dealt over so many hash groups.
GROUPS = ((0, 1), (64, 8), (512, 64))
_ROWS = 2000


def _spare(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` a linked set may lack."""
    return n - -(-percent * n // 100)


def _head_length(n: int, percent: int) -> int:
    need = _spare(n, percent) + 1
    return min(n, need + max(8, need // 4))


def _sets(docs: DataFrame, id_col: str, text: str, size: int, percent: int, whole: bool, carry: str | None = None) -> DataFrame:
    """id, n, digest and tokens: the whole sorted set, or its head of smallest hashes; and a ``carry`` column."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                n, digest, tokens = [], [], []
                for s in words.shingle_sets(part.column(1), size):
                    n.append(len(s))
                    digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                    tokens.append(s if whole else s[: _head_length(len(s), percent)])
                ends = np.concatenate([[0], np.cumsum([len(s) for s in tokens])]).astype(np.int32)
                flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), *part.columns[2:]],
                    names=["id", "n", "digest", "tokens", *part.schema.names[2:]],
                )

    more = [F.col(carry).cast("long").alias(carry)] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *more).mapInArrow(
        run, "id long, n long, digest binary, tokens array<bigint>" + (f", {carry} long" if carry else "")
    )


def _combined(percent: int, batches):
    """Signatures of classes that frequent tokens reach into, from their marked whole sets."""
    for batch in batches:
        rep, sig, n_out, room = [], [], [], []
        for r, n, tokens, marks in zip(*(batch.column(i).to_pylist() for i in range(4))):
            tokens, marks = np.array(tokens, dtype=np.int64), np.array(marks, dtype=bool)
            need = _spare(n, percent) + 1
            rare, often = np.sort(tokens[~marks]), np.sort(tokens[marks])
            single = rare[:need]
            rep += [r] * len(single)
            sig += single.tolist()
            n_out += [n] * len(single)
            room += (n - np.arange(len(single))).tolist()
            if len(rare) >= need:
                continue
            largest = n * 100 // percent
            for k, (least, groups) in enumerate(GROUPS):
                above = GROUPS[k + 1][0] if k + 1 < len(GROUPS) else np.inf
                if largest < least or n >= above:
                    continue
                group = words.mixed(often.view(np.uint64)) % np.uint64(groups)
                seen: dict[int, list[int]] = {}
                left = need - len(rare)
                for t, g in zip(often.tolist(), group.tolist()):
                    if left <= 0:
                        break
                    mates = seen.setdefault(g, [])
                    left -= bool(mates)
                    mates.append(t)
                for mates in seen.values():
                    m = np.array(mates, dtype=np.int64).view(np.uint64)
                    a, b = np.triu_indices(len(m), 1)
                    pairs = words.mixed(words.mixed(m[a] + np.uint64(groups)) + m[b]).view(np.int64)
                    rep += [r] * len(pairs)
                    sig += pairs.tolist()
                    n_out += [n] * len(pairs)
                    room += [n - len(rare)] * len(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sig, pa.int64()), pa.array(rep, pa.int64()), pa.array(n_out, pa.int64()), pa.array(room, pa.int64())],
            names=["sig", "rep", "n", "room"],
        )


def _possible(percent: int, n1: str, r1: str, n2: str, r2: str) -> Column:
    """Both sets leave room for the overlap that the threshold asks of them."""
    both = F.col(n1) + F.col(n2)
    return (F.least(r1, r2) * (100 + percent) >= percent * both) & (
        F.least(n1, n2) * 100 >= percent * F.greatest(n1, n2)
    )


def _screened(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """``a, b, possible, near`` of the pairs whose heads allow a link or share half of their tokens.

    A head holds all of its set's tokens up to its largest one. A linked set
    lacks at most ``n - overlap`` of a set's tokens, so of the tokens up to
    the smaller of both largest ones at most so many are missing.
    """
    def side(letter: str) -> DataFrame:
        top = F.when(F.size("tokens") == F.col("n"), F.lit(2**63 - 1)).otherwise(F.element_at("tokens", -1))
        return heads.select(
            F.col("rep").alias(letter), F.col("n").alias(f"n{letter}"), F.col("tokens").alias(f"t{letter}"), top.alias(f"top{letter}")
        )

    overlap = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    upto = F.least("topa", "topb")

    def enough(letter: str) -> Column:
        below = F.size(F.filter(f"t{letter}", lambda t: t <= F.col("upto")))
        return F.col("shared") >= below - (F.col(f"n{letter}") - F.col("overlap"))

    return (
        pairs.join(side("b"), "b").join(side("a"), "a")
        .withColumns({"shared": F.size(F.array_intersect("ta", "tb")), "overlap": overlap, "upto": upto})
        .select("a", "b", (enough("a") & enough("b")).alias("possible"), (F.col("shared") * 2 >= F.least(F.size("ta"), F.size("tb"))).alias("near"))
        .filter("possible or near").groupBy("a", "b").agg(F.max("possible").alias("possible"), F.max("near").alias("near"))
    )


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with their whole sets ``ta, tb``, sizes, and whether they link: intersection at least ``percent`` of the union."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return (
        pairs.join(right, "b").join(left, "a").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
        .withColumn("linked", F.col("shared") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("shared")))
    )


def _pivots(near: DataFrame, parts: int | None = None) -> DataFrame:
    """rep, pivot: the near leader with most near members, or the one that leaders above it lead up to.

    A leader's way up is the largest leader that it or one of its near members
    has. Each step goes to a leader with more near members, so the climb ends,
    and doubling its steps takes logarithmically many rounds. Any pivot gives
    the same links; one for a whole group of near copies leaves fewest pairs.
    """
    near = near.filter("near").select("a", "b")
    follow = near.groupBy("a").agg(F.count(F.lit(1)).alias("followers"))
    best = near.join(follow, "a").groupBy(F.col("b").alias("rep")).agg(
        F.max(F.struct("followers", (-F.col("a")).alias("minus"))).alias("m")
    ).select("rep", (-F.col("m.minus")).alias("pivot"), F.col("m.followers").alias("followers"))
    members = written(best, parts)
    over = near.join(members, F.col("b") == F.col("rep")).select(F.col("a").alias("rep"), "pivot", "followers").filter("pivot <> rep")
    best = written(
        members.unionByName(over).groupBy("rep").agg(F.max(F.struct("followers", (-F.col("pivot")).alias("minus"))).alias("m"))
        .select("rep", (-F.col("m.minus")).alias("pivot"), F.col("m.followers").alias("followers")),
        parts,
    )
    discard(members)
    while True:
        above = best.select(F.col("rep").alias("pivot"), F.col("pivot").alias("above"), F.col("followers").alias("more"))
        up = (F.col("more") > F.col("followers")) & (F.col("above") != F.col("rep"))
        climbed = written(
            best.join(above, "pivot", "left").withColumn("up", F.coalesce(up, F.lit(False))).select(
                "rep", F.when(F.col("up"), F.col("above")).otherwise(F.col("pivot")).alias("pivot"),
                F.when(F.col("up"), F.col("more")).otherwise(F.col("followers")).alias("followers"), "up",
            ),
            parts,
        )
        discard(best)
        best = climbed
        if best.filter("up").isEmpty():
            return best


def _differences(compared: DataFrame, pivots: DataFrame) -> DataFrame:
    """rep, pivot, n, diff: each member's pivot and the tokens that only one of the two has."""
    return compared.join(pivots.select(F.col("rep").alias("b"), F.col("pivot").alias("a")), ["a", "b"]).select(
        F.col("b").alias("rep"), F.col("a").alias("pivot"), F.col("nb").alias("n"),
        F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta")).alias("diff"),
    ).dropDuplicates(["rep"])


def _within_pivots(members: DataFrame, percent: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Possible pairs ``a, b`` of different components under one leader, found in what tells them from the leader.

    Two sets differ by what their differences from the leader do not share.
    A set within the threshold of its leader is in the leader's component, so
    of any pair in question one differs by more, and the differences of both
    must overlap: a prefix join on them, rarest tokens first, with positions.
    """
    tokens = members.select("rep", "pivot", "n", "component", F.size("diff").alias("size"), F.explode("diff").alias("token"))
    often = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    order = Window.partitionBy("pivot", "rep", "n").orderBy(F.coalesce("df", F.lit(1)), "token")
    placed = tokens.join(often, ["pivot", "token"], "left").withColumn("at", F.row_number().over(order) - 1)
    widest = F.expr(f"({100 - percent} * (n + n * 100 div {percent})) div {100 + percent}")
    placed = written(placed.filter(F.col("df").isNotNull() & (F.col("at") <= widest)), parts)
    keep = ("rep", "n", "size", "at", "component")
    x = placed.select("pivot", "token", *[F.col(c).alias(f"{c}1") for c in keep])
    y = placed.select("pivot", "token", *[F.col(c).alias(f"{c}2") for c in keep])
    apart = F.expr(f"({100 - percent} * (n1 + n2)) div {100 + percent}")
    room = F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2"))
    pairs = (
        x.join(y, ["pivot", "token"])
        .filter((F.col("rep1") < F.col("rep2")) & (F.col("component1") != F.col("component2")))
        .filter((F.least("n1", "n2") * 100 >= percent * F.greatest("n1", "n2")) & (2 * room >= F.col("size1") + F.col("size2") - apart))
        .select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))
    )
    return pairs, placed


def jaccard_index(docs: DataFrame, heads: DataFrame, id_col: str, text: str, size: int, percent: int, frequent: int, parts: int) -> DataFrame:
    """sig, rep, n, room: every class's signatures."""
    need = F.expr(f"n - (n * {percent} + 99) div 100 + 1").cast("int")
    tokens = heads.select("rep", "digest", "n", F.explode("tokens").alias("token"))
    often = written(tokens.groupBy("token").count().filter(F.col("count") > frequent).select("token", F.lit(True).alias("often")), parts)
    rares = written(
        tokens.join(often, "token", "left").filter(F.col("often").isNull())
        .groupBy("rep", "digest", "n").agg(F.sort_array(F.collect_list("token")).alias("rares")),
        parts,
    )
    easy = rares.filter(F.size("rares") >= need)
    singles = easy.select("rep", "n", F.posexplode(F.slice("rares", F.lit(1), need)).alias("at", "sig")).select(
        "sig", "rep", "n", (F.col("n") - F.col("at")).alias("room")
    )
    hard = written(heads.select("rep", "digest").join(easy.select("rep", "digest"), ["rep", "digest"], "left_anti"), parts)
    whole = _whole(docs, hard, id_col, text, size, percent)
    marked = (
        whole.select("id", "digest", "n", F.explode("tokens").alias("token")).join(often, "token", "left")
        .groupBy("id", "digest", "n")
        .agg(F.collect_list(F.struct("token", F.coalesce("often", F.lit(False)).alias("often"))).alias("t"))
        .select("id", "n", F.col("t.token"), F.col("t.often"))
    )
    combos = marked.mapInArrow(
        lambda batches: _combined(percent, batches), "sig long, rep long, n long, room long"
    )
    index = written(singles.unionByName(combos), parts)
    discard(often, rares, hard)
    return index


def _whole(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, size: int, percent: int) -> DataFrame:
    """id, digest, n and whole token sets of the wanted ``rep, digest`` classes, once each."""
    some = docs.join(wanted.select(F.col("rep").alias(id_col)).distinct(), id_col, "left_semi")
    return (
        _sets(some, id_col, text, size, percent, whole=True)
        .join(wanted.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")
        .dropDuplicates(["id", "digest"])
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, frequent: int = FREQUENT
) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links.

    Two rows link when ``100 * intersection >= percent * union`` of their
    shingle sets. Null and wordless texts have empty sets and no links. Rows
    with equal sets are linked. Rows that share an id are one document whose
    links are pooled. Rows without an id take the component of their copies,
    null if none has an id. ``percent`` is 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text).cast("string").alias("text"))
    labels = written(linked_rows(numbered(rows), size, percent, frequent))
    named = _pooled(labels)
    return labels.join(named, "component", "left").select(F.col("_key").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of each row that is the same at every reading.

    Rows that come straight from files are numbered by their place there.
    Other plans, which may deal their rows anew at each use, are written first.
    """
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    steps = set(re.findall(r"^[\s:+|-]*([A-Z]\w+)", plan, re.MULTILINE))
    by_place = docs.withColumn("_row", F.monotonically_increasing_id())
    return by_place if steps <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD"} else written(by_place)


def _pooled(labels: DataFrame) -> DataFrame:
    """component, component_id: the smallest key of a component, components that share a key being one."""
    keyed = labels.filter(F.col("_key").isNotNull()).groupBy("component", "_key").agg(F.count(F.lit(1)).alias("n"))
    ends = keyed.groupBy("_key").agg(F.min("component").alias("a"), F.max("component").alias("z")).filter("a < z")
    shared = written(keyed.join(ends, "_key").filter(F.col("component") > F.col("a")).select("a", F.col("component").alias("b")).distinct())
    low = keyed.groupBy("component").agg(F.min("_key").alias("component_id"))
    if shared.isEmpty():
        return low
    joined = _components(shared).toDF("component", "whole")
    whole = low.join(joined, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    least = whole.groupBy("whole").agg(F.min("component_id").alias("component_id"))
    return whole.select("component", "whole").join(least, "whole").select("component", "component_id")


def linked_rows(docs: DataFrame, size: int, percent: int, frequent: int = FREQUENT) -> DataFrame:
    """_row, _key, n and component, the smallest row reachable by links; ``docs`` has ``_row, _key, text``.

    Row numbers are unique, keys need not be.
    """
    id_col, text = "_row", "text"
    with_heads = written(_sets(docs, id_col, text, size, percent, whole=False, carry="_key"))
    parts = parts_for(with_heads)
    classes = written(
        with_heads.filter("n > 0").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens")),
        parts,
    )
    sets = written(with_heads.select("id", "_key", "n", "digest"), parts)
    discard(with_heads)
    heads = classes.filter("n > 1")
    index = jaccard_index(docs, heads, id_col, text, size, percent, frequent, parts)
    buckets = index.groupBy("sig").agg(
        F.count(F.lit(1)).alias("members"), F.max_by("rep", F.struct("room", -F.col("rep"))).alias("leader"),
        F.max_by(F.struct("n", "room"), F.struct("room", -F.col("rep"))).alias("first"),
    ).filter("members > 1")
    live = written(
        index.join(buckets, "sig").select("sig", "rep", "n", "room", "leader", F.col("first.n").alias("ln"), F.col("first.room").alias("lroom")),
        parts,
    )
    discard(index)

    def whole(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        return written(_whole(docs, heads.select("rep", "digest").join(ends, "rep", "left_semi"), id_col, text, size, percent), parts)

    star = live.filter(F.col("rep") != F.col("leader")).filter(_possible(percent, "n", "room", "ln", "lroom"))
    near = written(_screened(star.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), heads, percent), parts)
    chosen = _pivots(near, parts)
    pairs = written(near.select("a", "b").union(chosen.select(F.col("pivot").alias("a"), F.col("rep").alias("b"))).distinct(), parts)
    near_sets = whole(pairs)
    compared = written(_compared(pairs, near_sets, percent), parts)
    discard(near, pairs, near_sets)
    first = written(compared.filter("linked").select("a", "b").distinct(), parts)
    groups = written(_components(first, parts), parts)
    pivots = written(_differences(compared, chosen).join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep")), parts)
    grouped = written(
        live.select("sig", "rep", "n", "room").join(groups, "rep", "left").join(pivots.select("rep", "pivot"), "rep", "left")
        .withColumns({"component": F.coalesce("component", "rep"), "pivot": F.coalesce("pivot", "rep")}),
        parts,
    )
    discard(compared, chosen, groups, live)
    apart = grouped.groupBy("sig").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("sig")
    open_rows = written(grouped.join(apart, "sig", "left_semi"), parts)
    discard(grouped)
    fields = ("rep", "n", "room", "component", "pivot")
    x = open_rows.select("sig", *[F.col(c).alias(f"{c}1") for c in fields])
    y = open_rows.select("sig", *[F.col(c).alias(f"{c}2") for c in fields])
    across = (
        x.join(y, "sig")
        .filter((F.col("rep1") < F.col("rep2")) & (F.col("component1") != F.col("component2")) & (F.col("pivot1") != F.col("pivot2")))
        .filter(_possible(percent, "n1", "room1", "n2", "room2"))
        .select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))
    )
    within, placed = _within_pivots(pivots, percent, parts)
    rest = written(_screened(across.union(within).distinct(), heads, percent).filter("possible"), parts)
    discard(open_rows, pivots, placed)
    rest_sets = whole(rest)
    second = _compared(rest, rest_sets, percent).filter("linked").select("a", "b").distinct()
    links = written(first.unionByName(second), parts)
    discard(rest, rest_sets, first)
    final = _components(links, parts)
    named = written(
        classes.select("digest", "rep").join(final, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")),
        parts,
    )
    discard(classes, links)
    return sets.join(named, "digest", "left").select(
        F.col("id").alias("_row"), "_key", "n", F.coalesce("component", "id").alias("component")
    )


def _components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """rep, component for all ends of links."""
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    return connected_components(ends, links, parts).withColumnRenamed("id", "rep")
