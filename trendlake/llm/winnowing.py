"""Document fingerprints by winnowing, inside the JVM.

Every k-gram of code points gets a 50-bit hash as it rolls over the text, and
of every window of ``w`` neighbouring k-grams the one with the smallest hash is
selected, the rightmost among equals. Two texts that share a passage of
``k + w - 1`` or more code points therefore share a selected hash, with its
position in both; passages shorter than ``k`` are never matched.

The text is laid out with four bytes a code point, so that a k-gram is found
by its index. Windows are taken ``BLOCK`` at a time; nothing but the selected
grams is kept for a whole text, and no text leaves its row.

Null text is empty and selects nothing. A text with fewer than ``k`` code
points is one gram, one with fewer than ``w`` grams one window. Two empty
fingerprints are alike (1.0), an empty and another one are not (0.0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.llm.tables import empty_if_null, written

K = 25
W = 76
#: Windows handled at a time; the byte offset of a gram in its block fits in 14 bits.
BLOCK = 1024
#: Neighbouring documents that travel together, so that each meets the next one.
RUN = 64
_LOW = 16383
_SELECTED = "array<struct<position:bigint,hash:bigint>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` loops."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grams(block: Column, k: int) -> Column:
    """Hash of each k-gram of a block, its low 14 bits falling with the position."""
    last = F.lit(_LOW + 4 * k).cast("int") - F.octet_length(block)
    return F.transform(
        F.sequence(F.lit(_LOW), last, F.lit(-4)),
        lambda y: F.xxhash64(F.substring(block, F.lit(_LOW + 1) - y, F.lit(4 * k)))
        .bitwiseAND(F.lit(-_LOW - 1)).bitwiseOR(y.cast("long")),
    )


def _block_minima(grams: Column, w: int, first: Column) -> Column:
    """The selected grams in order; the first window's only if ``first``."""
    def state(cur: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), (cur.bitwiseAND(_LOW) - 4 * w).alias("gone"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = F.shiftright(F.lit(_LOW) - x.bitwiseAND(_LOW), 2).cast("int")  # the window's last gram
        again = F.array_min(F.slice(grams, end - (w - 2), F.lit(w)))
        return (
            F.when(x < a["cur"], state(x, F.concat(a["out"], F.array(x))))
            .when(x.bitwiseAND(_LOW) <= a["gone"], _let(again, lambda m: state(m, F.concat(a["out"], F.array(m)))))
            .otherwise(a)
        )

    start = F.array_min(F.slice(grams, 1, w))
    seen = F.when(first, F.array(start)).otherwise(F.array().cast("array<bigint>"))
    rest = F.slice(grams, w + 1, F.greatest(F.size(grams) - w, F.lit(0)))
    return F.aggregate(rest, state(start, seen), step, lambda a: a["out"])


def selected(text: Column, k: int = K, w: int = W) -> Column:
    """The selected grams of a text: array of (position, hash) in order of position."""
    wide, span = 4 * (BLOCK + w + k - 1), F.lit(4 * k)

    def in_block(whole: Column, at: Column) -> Column:
        block = F.substring(whole, at * 4 + 1, F.lit(wide))
        minima = _let(_let(block, lambda b: _grams(b, k)), lambda g: _block_minima(g, w, at == 0))
        return F.transform(
            minima,
            lambda v: F.struct(
                (F.shiftright(F.lit(_LOW) - v.bitwiseAND(_LOW), 2) + at).alias("position"), F.shiftright(v, 14).alias("hash")
            ),
        )

    def of(whole: Column) -> Column:
        windows = F.shiftright(F.octet_length(whole), 2) - (k + w - 2)
        starts = F.sequence(F.lit(0), F.greatest(windows - 2, F.lit(0)), F.lit(BLOCK))
        alone = F.struct(F.lit(0).cast("long").alias("position"), F.shiftright(F.xxhash64(whole), 14).alias("hash"))
        return (
            F.when(F.octet_length(whole) == 0, F.array().cast(_SELECTED))
            .when(F.octet_length(whole) < span, F.array(alone))
            .otherwise(F.flatten(F.transform(starts, lambda at: in_block(whole, at))))
        )

    return _let(F.encode(empty_if_null(text), "UTF-32"), of)


def _until(found: Column, chars: Column, k: int, w: int) -> Column:
    """What the windows within the first ``chars`` code points select, given what those of the whole text do."""
    def opened(e: Column, i: Column) -> Column:
        before = F.get(found, i - 1)
        return F.when(i == 0, 0).when(e["hash"] <= before["hash"], e["position"] - (w - 1)).otherwise(before["position"] + 1)

    return F.filter(found, lambda e, i: opened(e, i) <= chars - (k + w - 1))


def spliced(own: Column, head: Column, other: Column, tail: Column, k: int = K, w: int = W) -> Column:
    """``selected(concat(head, tail))`` where head and tail start texts of which ``own`` and ``other`` are selected.

    Windows inside the head or the tail select what they select in the whole
    texts; only those across the seam are taken anew.
    """
    reach = k + w - 2
    seam = F.concat(F.right(head, F.lit(reach)), F.left(tail, F.lit(reach)))
    short = selected(F.concat(head, tail), k, w)

    def moved(found: Column, by: Column) -> Column:
        return F.transform(found, lambda e: F.struct((e["position"] + by).alias("position"), e["hash"].alias("hash")))

    def long(a: Column, b: Column) -> Column:
        across = F.when(F.length(seam) > reach, selected(seam, k, w)).otherwise(F.array().cast(_SELECTED))
        return F.array_distinct(F.concat(
            _let(own, lambda o: _until(o, a, k, w)), moved(across, F.greatest(a - reach, F.lit(0))),
            moved(_let(other, lambda o: _until(o, b, k, w)), a),
        ))

    # lengths are bound, or every element would count them again
    sizes = F.struct(F.length(head).alias("a"), F.length(tail).alias("b"))
    return _let(sizes, lambda n: F.when(n["a"] + n["b"] <= reach, short).otherwise(long(n["a"], n["b"])))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the selected hashes."""
    def share(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y))
        either = F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - common
        return F.when(either == 0, 1.0).otherwise(common / either)

    return share(a["hash"], b["hash"])


def as_text(found: Column) -> Column:
    """``position:hash`` (hexadecimal), comma-joined."""
    return F.array_join(F.transform(found, lambda e: F.concat_ws(":", e["position"], F.lower(F.hex(e["hash"].bitwiseAND((1 << 50) - 1))))), ",")


def beside_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``id_col, text, found, next_text, next_found`` of every row, next by falling id; after the last comes the first.

    Null ids come last and rows of one id are ordered by a hash of their text;
    equal rows in any order. Rows are sorted over ranges and written with
    their rank; runs of ``RUN`` ranks and the row after each then meet in one
    place, however often an id repeats.
    """
    rows = df.select(F.col(id_col).alias("_id"), empty_if_null(text).alias("_text"))
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("_text"), F.monotonically_increasing_id()]
    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(F.col("_id").desc_nulls_last(), F.xxhash64("_text"))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftrightunsigned("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    every = Window.orderBy("_part")  # one row for each partition of the sort
    starts = counts.select(
        "_part", (F.sum("_n").over(every) - F.col("_n")).alias("_start"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_rows"),
    )
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    rank = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)

    def place(at: Column, run: Column, guest: bool) -> Column:
        return F.struct(at.alias("at"), run.alias("run"), F.lit(guest).alias("guest"))

    after = F.when(rank == 0, F.col("_rows")).otherwise(rank)
    host = place(rank, F.floor(rank / RUN), False)
    guest = place(after, F.floor((after - 1) / RUN), True)
    met = ranked.select("_id", "_text", F.explode(F.when(rank % RUN == 0, F.array(host, guest)).otherwise(F.array(host))).alias("_p"))
    met = met.select("_id", "_text", "_p.*").repartition("run").withColumn("found", selected(F.col("_text"), k, w))
    run = Window.partitionBy("run").orderBy("at")
    return met.select(
        F.col("_id").alias(id_col), F.col("_text").alias("text"), "found", "guest",
        F.lead("_text").over(run).alias("next_text"), F.lead("found").over(run).alias("next_found"),
    ).filter("not guest").drop("guest")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and how like it is to that and to the next row's.

    The edited text has its last half replaced by the first as many code
    points of the next row's text. Only ``id_col`` and ``text`` are read,
    other columns never clash. An empty table gives an empty table.
    """
    n = F.length("text")
    both = (
        beside_next(df, id_col, text, k, w)
        .withColumn("head", F.left("text", n - F.floor(n / 2).cast("int")))
        .withColumn("tail", F.left("next_text", F.floor(n / 2).cast("int")))
        .withColumn("edited", spliced(F.col("found"), F.col("head"), F.col("next_found"), F.col("tail"), k, w))
    )
    return both.select(
        id_col, n.cast("long").alias("n_chars"), F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"),
        as_text(F.col("found")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited")).alias("near_edited"), likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
