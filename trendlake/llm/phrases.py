"""Phrase collocations, counted with counting quotient filters.

Texts are cut into blocks of bounded size, each with the list of its own words.
Words that occur often enough in their language get a number; a block becomes
a sequence of word numbers with gaps. As no phrase can occur more often than a
part of it, only pairs of numbered words are counted, then only longer phrases
whose pairs are all frequent: a phrase of three is packed from the number of
its first pair and a word, one of four from the numbers of two pairs.

Every block counts its packed phrases in a counting quotient filter, which is
sent in slices of the permuted key; the slices of all blocks meet and are
merged as sorted lists. A merge also answers to every block which of its pairs
are frequent, so that no table of words or pairs is broadcast. A slice is never
worse than one row for each distinct phrase of a block, a frequent phrase is
one entry in each block.

Null text is empty, a null language is ``und``. Rows need no id; repeated rows
count once each. Only the text and the language are read, so other columns never
clash. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.llm import quotient_filter as qf
from trendlake.llm.tables import discard, empty_if_null, written
from trendlake.operators.joins import number_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(qf)

MIN_COUNT = 30
TOP = 2000
#: A shorter phrase goes if a longer one that holds it has this percentage of its occurrences.
COVER_PERCENT = 80
SCORE_SCALE = 2_000_000
#: Bytes of text in a block; only a piece that is longer makes a longer one.
BLOCK_BYTES = 1 << 22
#: Entries of a merge, before equal ones are added up.
MERGE_ENTRIES = 1 << 19

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[list(b" \t")] = 1
_CLASS[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cuts(ends: np.ndarray, size: int) -> list[int]:
    """Where blocks of a text of ``size`` bytes begin and end: at piece ends."""
    out = [0]
    while out[-1] < size:
        want = out[-1] + BLOCK_BYTES
        at = int(np.searchsorted(ends, want))
        if want >= size:
            out.append(size)
        elif at and ends[at - 1] >= out[-1]:
            out.append(int(ends[at - 1]) + 1)
        else:  # one long piece
            out.append(int(ends[at]) + 1 if at < len(ends) else size)
    return out


def coded(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a text's bytes, and the text as their positions with -1 between pieces."""
    kind = _CLASS[data]
    inside = kind == 0
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    letters = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    found = words.dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    return found.dictionary, np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, np.int32(-1))


def _blocks(batches):
    """Blocks of each language: number, language, words, how often each occurs, codes."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        which, texts = langs.indices.to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary())
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            data = np.frombuffer(b"\n".join(texts.take(pa.array(np.flatnonzero(which == i))).to_pylist()), np.uint8)
            cuts = _cuts(np.flatnonzero(_CLASS[data] == 2), len(data))
            for a, b in zip(cuts, cuts[1:]):
                words, codes = coded(data[a:b])
                if not len(words):
                    continue
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([lang], pa.string()),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                        pa.array([counts], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()),
                    ],
                    names=["block", "lang", "words", "counts", "codes"],
                )
                number += 1


def _numbered(batches):
    """The codes of a block as word numbers, -1 for rare words and between pieces."""
    for batch in batches:
        for row in range(batch.num_rows):
            codes = np.frombuffer(batch.column(1)[row].as_buffer(), np.int32)
            table = np.full(int(codes.max(initial=0)) + 2, -1, dtype=np.int64)
            if batch.column(2)[row].is_valid:
                table[batch.column(2)[row].values.to_numpy()] = batch.column(3)[row].values.to_numpy()
            numbers = table[codes]  # -1 takes the last place, which no word has
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, 1), pa.array([numbers.astype(np.int32).tobytes()], pa.binary())], names=["block", "ids"]
            )


def _slices(parts, block: pa.Array):
    for words, keys, bits, cuts in parts:
        found = qf.sliced(keys, bits, min(cuts, bits))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(found), words, dtype=np.int32)), pa.array([r for r, _ in found], pa.int64()),
                block.take(pa.array(np.zeros(len(found), dtype=np.int64))), pa.array([f for _, f in found], pa.binary()),
            ],
            names=["words", "range", "block", "filter"],
        )


def _pair_slices(width: int, cuts: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = np.frombuffer(batch.column(1)[row].as_buffer(), np.int32).astype(np.int64)
                both = (s[:-1] >= 0) & (s[1:] >= 0)
                yield from _slices([(2, (s[:-1] << width | s[1:])[both], 2 * width, cuts)], batch.column(0).slice(row, 1))

    return run


def _longer_slices(width: int, pair_width: int, cuts: int):
    """Filters of phrases of three and four words whose pairs are all frequent."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = np.frombuffer(batch.column(1)[row].as_buffer(), np.int32).astype(np.int64)
                keys = np.concatenate([v.values.to_numpy() for v in batch.column(2)[row].values])
                ids = np.concatenate([v.values.to_numpy() for v in batch.column(3)[row].values])
                order = np.argsort(keys)
                keys, ids = keys[order], ids[order]
                pair = np.where((s[:-1] >= 0) & (s[1:] >= 0), s[:-1] << width | s[1:], -1)
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                pair = np.where(keys[at] == pair, ids[at], -1)
                three = (pair[:-1] >= 0) & (pair[1:] >= 0)
                four = three[:-1] & (pair[2:] >= 0)
                yield from _slices(
                    [
                        (3, (pair[:-1] << width | s[2:])[three], pair_width + width, cuts),
                        (4, (pair[:-2] << pair_width | pair[2:])[four], 2 * pair_width, cuts),
                    ],
                    batch.column(0).slice(row, 1),
                )

    return run


def _merged(bits: dict[int, int], cuts: int, least: int, answer: bool):
    """One range of all blocks' filters: frequent keys with counts, and (with ``answer``) those of each block."""
    schema = pa.schema([
        ("words", pa.int32()), ("range", pa.int64()), ("block", pa.int64()), ("keys", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ])

    def run(table: pa.Table) -> pa.Table:
        words, part = table.column("words")[0].as_py(), table.column("range")[0].as_py()
        low = bits[words] - min(cuts, bits[words])
        filters = [qf.unpacked(f.as_buffer(), low) for f in table.column("filter")]
        values, counts = qf.counted(np.concatenate([v for v, _ in filters]), np.concatenate([c for _, c in filters]))
        often = counts >= least
        values, counts = values[often], counts[often]
        keys = qf.restored(values | np.uint64(part << low), bits[words]).astype(np.int64)
        rows = [(words, part, None, keys, np.arange(len(keys)), counts)] if len(keys) else []
        if answer and len(keys):
            for block, (own, _) in zip(table.column("block").to_pylist(), filters):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                places = at[values[at] == own]
                if len(places):
                    rows.append((words, part, block, keys[places], places, None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


_MERGED = "words int, range long, block long, keys array<bigint>, places array<bigint>, counts array<bigint>"


def phrase_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of all phrases of one to four words that occur at least ``min_count`` times in a language.

    Returns ``ids, a`` (phrases as arrays of word numbers), ``number, lang,
    word`` and the languages' word totals ``lang, n``; all three are written
    tables.
    """
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), empty_if_null(text).alias("text"))
    blocks = written(texts.mapInArrow(_blocks, "block long, lang string, words array<string>, counts array<bigint>, codes binary"))
    totals = written(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n")))
    listed = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
        "block", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("c")
    )
    often = listed.groupBy("lang", "word").agg(F.sum("c").alias("a")).filter(F.col("a") >= min_count)
    # neither space nor tab is part of a word, so the joined name is unique
    words = written(number_rows(often.withColumn("_name", F.concat_ws("\t", "lang", "word")), "_name").drop("_name"))
    size = words.count()
    width = max(1, (size - 1).bit_length())
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    cuts = max(0, (all_words // MERGE_ENTRIES).bit_length())
    if width > 31:
        raise ValueError("more frequent words than fit in 31 bits")
    own = (
        listed.join(words.select("lang", "word", "number"), ["lang", "word"])
        .groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("number").alias("number"))
    )
    numbered = written(blocks.select("block", "codes").join(own, "block", "left").mapInArrow(_numbered, "block long, ids binary"))
    discard(blocks)
    slices = "words int, range long, block long, filter binary"
    pairs = written(
        numbered.mapInArrow(_pair_slices(width, cuts), slices)
        .groupBy("words", "range").applyInArrow(_merged({2: 2 * width}, cuts, min_count, True), _MERGED)
    )
    kept = pairs.filter("block is null")
    # one row for each range: MERGE_ENTRIES words or more
    starts = written(kept.select("range", F.size("keys").cast("long").alias("n")).withColumn(
        "start", F.sum("n").over(Window.orderBy("range")) - F.col("n")
    ))
    n_pairs = starts.agg(F.sum("n")).first()[0] or 0
    pair_width = max(1, (n_pairs - 1).bit_length())
    if pair_width > 31:
        raise ValueError("more frequent pairs than fit in 31 bits")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(starts, "range").withColumn("ids", F.transform("places", lambda p: p + F.col("start")))

    known = placed(pairs.filter("block is not null")).groupBy("block").agg(
        F.collect_list("keys").alias("keys"), F.collect_list("ids").alias("pair_ids")
    )
    longer = written(
        numbered.join(known, "block").mapInArrow(_longer_slices(width, pair_width, cuts), slices)
        .groupBy("words", "range").applyInArrow(_merged({3: pair_width + width, 4: 2 * pair_width}, cuts, min_count, False), _MERGED)
    )
    discard(numbered)

    def low(column: Column, bits: int) -> Column:
        return column.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def counts(rows: DataFrame, *more: str) -> DataFrame:
        zipped = F.arrays_zip("keys", "counts", *more)
        return rows.select("words", F.explode(zipped).alias("e")).select("words", "e.*")

    two = written(counts(placed(kept), "ids").select(
        F.col("ids").alias("pair"), F.array(F.shiftright("keys", width), low(F.col("keys"), width)).alias("w"), F.col("counts").alias("a")
    ))
    def split(column: str, bits: dict[int, int], part: str) -> Column:
        parts = {m: F.shiftright(column, b) if part == "high" else low(F.col(column), b) for m, b in bits.items()}
        return F.when(F.col("words") == 3, parts[3]).otherwise(parts[4])

    tail_bits = {3: width, 4: pair_width}
    tails = counts(longer).select(
        "words", split("keys", tail_bits, "high").alias("pair"), split("keys", tail_bits, "low").alias("rest"), F.col("counts").alias("a")
    ).join(two.select("pair", "w"), "pair")
    three = tails.filter("words = 3").select(F.concat("w", F.array("rest")).alias("ids"), "a")
    four = tails.filter("words = 4").join(two.select(F.col("pair").alias("rest"), F.col("w").alias("w2")), "rest").select(
        F.concat("w", "w2").alias("ids"), "a"
    )
    one = words.select(F.array("number").alias("ids"), "a")
    phrases = written(reduce(DataFrame.unionByName, [one, two.select(F.col("w").alias("ids"), "a"), three, four]))
    discard(pairs, starts, longer, two)
    return phrases, words.select("number", "lang", "word"), totals


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, cover_percent: int = COVER_PERCENT
) -> DataFrame:
    """The best phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    The score is ``floor(SCORE_SCALE * a / (l + r))`` of the cut where it is
    least (of equal ones the first), l and r being the counts of the two
    parts. Phrases whose words stand in a longer one that has ``cover_percent``
    of their count are left out. Sums and products are decimals.
    """
    phrases, words, totals = phrase_counts(df, text, lang, min_count)
    candidates = phrases.filter(F.size("ids") > 1)
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    left, right = F.slice("ids", 1, F.col("k")), F.slice("ids", F.col("k") + 1, F.size("ids"))
    parts = candidates.select("ids", "a", cut).select("ids", "a", "k", left.alias("left"), right.alias("right"))
    halves = parts.join(phrases.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(
        phrases.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right"
    )
    score = F.expr(f"cast({SCORE_SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = halves.withColumn("score", score).groupBy("ids").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.any_value("a").alias("a")
    )
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("ids") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m)),
    ))
    inside = candidates.filter(F.size("ids") > 2).select(F.explode(spans).alias("ids"), F.col("a").alias("longer"))
    inside = inside.groupBy("ids").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(100 * _exact("longer") >= cover_percent * _exact("a"), F.lit(False))
    left_over = written(scored.join(inside, "ids", "left").filter(~covered).select("ids", "a", "cut.*"))
    named = (
        left_over.select("ids", F.posexplode("ids").alias("at", "number")).join(words, "number")
        .groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"), F.any_value("lang").alias("lang"))
        .select("ids", "lang", F.array_join("w.word", " ").alias("phrase"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left_over.join(named, "ids").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
