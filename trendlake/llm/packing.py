"""Best-fit packing planned on a length histogram.

Documents become pieces of at most ``length`` tokens. Only the histogram of
piece lengths, at most ``length`` rows, reaches the driver. There best-fit
decreasing runs over counts: for each length, longest first, all pieces of
that length go to the open sequences with the least room that still fits.
The plan is a table of runs (a length, ranks within it, and the sequences and
offsets they take); pieces look their slot up by their rank within length.

Ranks are numbered within (length, hash group) and shifted by the counts of
the groups before, so no task holds all pieces of one length.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlake.llm.tables import empty_if_null, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 1024
END_ID = 2
#: Pieces that one (length, hash group) holds on average in the fullest length.
GROUP_ROWS = 200_000
_KEPT = 500_000  # remembered words in each of two generations of a task's process
_BATCH_BYTES = 1 << 21
_JOINED = 64
#: White space in any reading.
_BARE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space and a word with no other space and no white space at its ends.
_PLAIN = rf"^ [^{_BARE}](?:[^ ]*[^{_BARE}])?$"
#: A letter or digit in every version of Unicode, and the marks from which the tokenizer parts it.
_STEM, _MARKS = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]", r"[!-/:-@\[-`{-~]+"


class WordEncoder:
    """Ids of a byte-level tokenizer, remembered by word.

    The tokenizer never joins across a single space between two visible
    characters, so the stretches between such spaces can be encoded one by
    one; nor across the end of a word before the marks that close it, so words
    are remembered without them. The distinct stretches of a batch are found
    first; those not seen before go through the tokenizer in one call, and the
    ids of all texts are then gathered. A text that holds one of the
    tokenizer's added tokens is encoded as a whole. Of two generations of
    remembered words the older is dropped when the newer is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _known(self, stretches: list[str]) -> list[bytes]:
        out = list(map(self.new.get, stretches))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = self.old.get(stretches[i])
        missing = [i for i in missing if out[i] is None]
        if missing:
            for i, ids in zip(missing, self._encoded([stretches[i] for i in missing])):
                out[i] = ids
                if len(stretches[i]) <= 64:
                    if len(self.new) >= _KEPT:
                        self.old, self.new = self.new, {}
                    self.new[stretches[i]] = ids
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, stretches: list[str]) -> list[bytes]:
        """Ids of unseen stretches. Plain words go through the tokenizer many at a time: each begins at a token that begins with a space."""
        marked = pc.match_substring_regex(pa.array(stretches, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(marked).tolist(), np.flatnonzero(~marked).tolist()
        runs = [plain[a : a + _JOINED] for a in range(0, len(plain), _JOINED)]
        out = [b""] * len(stretches)
        for run, ids in zip(runs, self._ids(["".join([stretches[i] for i in run]) for run in runs])):
            cuts = np.flatnonzero(self.spaced[ids]) * 4
            if len(cuts) != len(run):  # not a tokenizer that begins words so
                rest += run
                continue
            data, cuts = ids.tobytes(), [*cuts.tolist(), len(ids) * 4]
            for i, a, b in zip(run, cuts, cuts[1:]):
                out[i] = data[a:b]
        for i, ids in zip(rest, self._ids([stretches[i] for i in rest])):
            out[i] = ids.tobytes()
        return out

    def encode_all(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of every text as little-endian 32-bit bytes."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        added = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out = self._spaced(pc.if_else(pa.array(added), "", texts) if added.any() else texts)
        for i in np.flatnonzero(added).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        lists = pc.split_pattern(texts, " ")
        found = lists.flatten().dictionary_encode()
        words, codes = found.dictionary, found.indices.to_numpy(zero_copy_only=False)

        def marked(pattern: str) -> np.ndarray:
            return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)[codes]

        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        # where a word may not be parted from the one before or after it
        before, after = marked(f"^(?:$|[{_BARE}])"), marked(f"(?:^|[{_BARE}])$")
        first = np.zeros(len(codes), dtype=bool)
        first[ends[:-1]] = first[:1] = True
        opens = np.flatnonzero(first | ~before & ~np.concatenate([[True], after[:-1]]))
        size = np.diff(np.append(opens, len(codes)))
        # a single word inside a text is known by its code, every other stretch is written out
        other = np.flatnonzero((size > 1) | first[opens])
        inside = np.ones(len(opens), dtype=bool)
        inside[other] = False
        items = codes[opens].astype(np.int64)
        used = np.flatnonzero(np.bincount(items[inside], minlength=len(words)))
        place = np.zeros(len(words), dtype=np.int64)
        place[used] = np.arange(len(used))
        pieces = _strings(words.take(pa.array(codes[_ranges(opens[other], size[other])])))
        names: dict[str, int] = {}
        named, a = [], 0
        for head, n in zip(first[opens[other]].tolist(), size[other].tolist()):
            named.append(names.setdefault(("" if head else " ") + " ".join(pieces[a : a + n]), len(names)))
            a += n
        items[inside], items[other] = place[items[inside]], len(used) + np.array(named, dtype=np.int64)
        # a word is its stem and its marks, either of which many words share
        singles = words.take(pa.array(used))
        stems = pc.replace_substring_regex(singles, f"({_STEM}){_MARKS}$", r"\1")
        cut = pc.not_equal(stems, singles)
        marks = pc.replace_substring_regex(singles.filter(cut), f"(?s)^.*{_STEM}({_MARKS})$", r"\1").dictionary_encode()
        stems = stems.dictionary_encode()
        n = len(stems.dictionary), len(marks.dictionary)
        ids = self._known([*(" " + s for s in _strings(stems.dictionary)), *_strings(marks.dictionary), *names]) + [b""]
        pairs = np.full((len(used) + len(names), 2), len(ids) - 1)
        pairs[: len(used), 0] = stems.indices
        pairs[np.flatnonzero(cut), 1] = n[0] + marks.indices.to_numpy(zero_copy_only=False)
        pairs[len(used) :, 0] = sum(n) + np.arange(len(names))
        flat, sizes = _gathered(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64), pairs.ravel())
        flat, each = _gathered(flat, sizes.reshape(-1, 2).sum(axis=1), items)
        data = flat.tobytes()
        edges = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(opens, np.concatenate([[0], ends]))] * 4
        return [data[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``starts``, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _gathered(joined: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of arrays that lie joined, those with the numbers ``items``, joined, and their sizes."""
    each = sizes[items]
    return joined[_ranges((np.cumsum(sizes) - sizes)[items], each)], each


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts of bounded size, one text at least."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if i > a and held + n > _BATCH_BYTES:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every document's pieces.

    A document is its token ids and ``END_ID``; null text is just the latter.
    Only documents above ``length`` are cut; the first piece takes what does
    not fill whole pieces. A task holds the tokens of about ``_BATCH_BYTES``
    of text at a time.
    """

    def run(batches):
        code = encoder(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column("id"), batch.column("text")
            for a, b in _parts(pc.binary_length(texts).to_pylist()):
                encoded = [data + end for data in code.encode_all(texts.slice(a, b - a))]
                total = np.array([len(data) // 4 for data in encoded], dtype=np.int64)
                count = -(-total // length)
                row = np.repeat(np.arange(b - a), count)
                piece = _ranges(np.zeros(b - a, dtype=np.int64), count)
                stop = total[row] - (count[row] - 1 - piece) * length
                start = np.where(piece == 0, 0, stop - length)
                parts = [encoded[r][4 * x : 4 * y] for r, x, y in zip(row.tolist(), start.tolist(), stop.tolist())]
                crc = np.array([zlib.crc32(part) for part in parts], dtype=np.int64)
                columns = [keys.slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, stop - start, crc))]
                if ids:
                    edges = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(edges, np.frombuffer(b"".join(parts), "<u4").astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    kind = df.schema[id_col].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    return df.select(F.col(id_col).cast("long" if whole else "string").alias("id"), empty_if_null(text).alias("text")).mapInArrow(
        run, f"id {'long' if whole else 'string'}, piece int, start long, length long, ids_crc32 long" + (", ids array<bigint>" if ids else "")
    ).withColumnRenamed("id", id_col)


def plan_runs(counts: dict[int, int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Yields (piece length, first rank, number of pieces, pieces per sequence,
    first sequence, offset in it): within a run the pieces fill consecutive
    sequences, so many in each, one after the other from the offset.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    opened = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            fit = min((r for r in room if r >= size), default=None)
            if fit is None:
                per = length // size
                bins = max(1, left // per)
                room.setdefault(length, []).append((opened, bins))
                opened += bins
                fit = length
            per = min(fit // size, left)
            first, bins = room[fit].pop()
            if not room[fit]:
                del room[fit]
            used = min(bins, left // per)
            if used < bins:
                room.setdefault(fit, []).append((first + used, bins - used))
            yield size, rank, used * per, per, first, length - fit
            rank, left = rank + used * per, left - used * per
            if fit > per * size:
                room.setdefault(fit - per * size, []).append((first, used))


def best_fit(pieces: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """``pieces`` (one row per piece, with ``length``) with sequence_id and offset.

    Equal rows are interchangeable. Pieces must be 1 to ``length`` long.
    ``pieces`` should be a written table: it is read twice.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(list(plan_runs(counted, length)), dtype=np.int64).reshape(-1, 6)
    groups = max(1, -(-max(counted.values(), default=0) // GROUP_ROWS))
    starts = runs[:, 0] << 44 | runs[:, 1]
    order = np.argsort(starts)
    runs, starts = runs[order], starts[order]

    @F.pandas_udf("sequence_id long, offset long")
    def slot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = runs[np.searchsorted(starts, size << 44 | rank, side="right") - 1]
        place = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + place // run[:, 3], "offset": run[:, 5] + place % run[:, 3] * size})

    # Ranks follow a hash with the row's place in the table, so that copies of one document are spread.
    dealt = pieces.withColumn("_h", F.xxhash64(key, "piece", "ids_crc32", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_g", F.pmod("_h", F.lit(groups)).cast("int"))
    within = Window.partitionBy("length", "_g").orderBy("_h", key, "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    if groups > 1:
        ranked = ranked.join(shifts, ["length", "_g"])
    else:
        ranked = ranked.withColumn("_shift", F.lit(0))
    placed = ranked.withColumn("_slot", slot(F.col("length"), (F.col("_rank") + F.col("_shift")).cast("long")))
    return placed.select(*pieces.columns, F.col("_slot.sequence_id").alias("sequence_id"), F.col("_slot.offset").alias("offset"))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every piece of every document with its place in the packed sequences.

    Extra columns of ``df`` are not carried. An empty table gives an empty one.
    """
    return best_fit(written(token_pieces(df, tokenizer, id_col, text, length)), length, id_col)
