"""Secrets by dictionary-primed compression.

Candidates are strings in a sensitive context: what fixed patterns name, and
all long tokens in the lines of a word that announces a credential, in the
lines after it, and in PEM private keys. For each one the
marginal compressed size is measured: the bytes zstandard needs for it when
primed with common identifiers and with the text around it. A candidate that
its surroundings and the dictionary hardly help to compress is novel.

Pattern spans (assign, access, hex) are always reported; their novelty is
given beside them. Other candidates are reported as ``novel`` only if they
are incompressible, mix letters and digits and lie outside pattern spans.
"""

from __future__ import annotations

import bisect
import re
import sys

import pandas as pd
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.llm import spans as sp
from trendlake.llm.tables import empty_if_null

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sp)

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
AROUND = 256  # code points of surrounding text on either side
MIN_NOVEL_SHARE = 0.6  # marginal bytes per byte of the candidate
MIN_NOVEL_HEX_SHARE = 0.4  # the same per hex digit of a candidate of hex digits
THOROUGH = 9  # compression level that finds copies at every place
NEXT_LINES = 3  # lines after one with a cue that belong to its context

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CUE = re.compile(
    r"authorization|bearer|credential|(?:private|access|api)[_ -]?key|client[_ -]?secret|auth|pwd|secret|token|passw", re.I | re.A
)
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----(.*?)-----END", re.S)
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_MARKS = str.maketrans("", "", "+/_=-")
_ONE_CASE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_PART = re.compile(r"[^=]{20,}=*(?![^=])|[^=]{20,}")  # between equals signs; those at the end are padding
#: Common identifiers of code and configuration, for the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret credential authorization bearer "
    "username user_id session_id request response config settings environment default localhost example test sample "
    "function return import class public static const string number boolean value result index length count name path "
    "http https www com org net html json yaml xml utf-8 base64 sha256 md5 uuid true false null none undefined "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef xxxxxxxx changeme placeholder"
).encode()


def marginal_bytes(text: str, a: int, b: int, level: int = 3) -> int:
    """Bytes that ``text[a:b]`` adds once the compressor knows the identifiers and the text around it."""
    around = text[max(0, a - AROUND) : a] + "\n" + text[b : b + AROUND]
    primed = zstandard.ZstdCompressionDict(
        IDENTIFIERS + b"\n" + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    engine = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    own = text[a:b].encode("utf-8", "replace")
    return max(0, len(engine.compress(own)) - len(engine.compress(b"")))


def _least_bytes(own: str) -> float:
    """Marginal bytes from which a candidate is novel; a random hex digit takes half a byte and not more."""
    core = own.translate(_MARKS)
    if _ONE_CASE_HEX.fullmatch(core):
        return MIN_NOVEL_HEX_SHARE * len(core)
    return MIN_NOVEL_SHARE * len(own)


def _long_tokens(text: str) -> list[tuple[int, int]]:
    """Runs of at least 20 characters of keys, cut at equals signs where a part is that long, mixing letters and digits."""
    out = []
    for m in _LONG.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])] or [m.span()]
        out += [(a, b) for a, b in parts if re.search("[0-9]", text[a:b]) and re.search("[A-Za-z]", text[a:b])]
    return out


def _sensitive_parts(text: str) -> list[tuple[int, int]]:
    """Ordered, separate stretches of text in a sensitive context.

    These are whole lines with a cue and the ``NEXT_LINES`` lines after them
    that are not blank, lines that are one long token not counted (so wrapped
    keys are followed to their end), and the bodies of PEM private keys.
    """
    if not _CUE.search(text):
        return []
    out, at, left = [], 0, 0
    for line in text.split("\n"):
        if _CUE.search(line):
            left = NEXT_LINES + 1
        if left:
            out.append((at, at + len(line)))
            own = line.strip()
            left -= bool(own) and not _LONG.fullmatch(own)
        at += len(line) + 1
    return _merged(out + [m.span(1) for m in _PEM.finditer(text)])


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _meets(parts: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the ordered, separate stretches overlaps ``a..b``."""
    i = bisect.bisect_left(parts, (b,)) - 1
    return i >= 0 and parts[i][1] > a


def find_secrets(text: str) -> tuple[list[sp.Span], list[int]]:
    """Spans of one text, and the marginal bytes of each candidate value among them."""
    found, values = [], []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append(("assign", m.start(), m.end()))
            values.append((m.start(2), m.end(2)))
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 16:
            found.append(("access", m.start(), m.end()))
            values.append((m.start(), m.end()))
    for m in _HEX.finditer(text):
        found.append(("hex", m.start(), m.end()))
        values.append((m.start(), m.end()))
    cost = [marginal_bytes(text, a, b) for a, b in values]
    tokens = _long_tokens(text)
    near, known = (_sensitive_parts(text), _merged([(a, b) for _, a, b in found])) if tokens else ([], [])
    for a, b in tokens:
        if _meets(near, a, b) and not _meets(known, a, b):
            own_cost = marginal_bytes(text, a, b)
            least = _least_bytes(text[a:b])
            # level 3 looks up only some places of what primes it; what it finds novel is searched for everywhere
            if own_cost >= least and marginal_bytes(text, a, b, THOROUGH) >= least:
                found.append(("novel", a, b))
                cost.append(own_cost)
    return found, cost


def secret_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, base_sha256, spans of all kinds, and the largest novelty.

    ``max_marginal`` is the largest number of marginal bytes of the row's
    spans, 0 without spans. Null text is empty. Rows are independent of each
    other; an empty table gives an empty one.
    """

    def run(frames):
        for frame in frames:
            out = []
            for t in frame["text"]:
                all_spans, cost = find_secrets(t)
                base = [s for s in all_spans if s[0] in BASE]
                counts = [sum(s[0] == k for s in base) for k in BASE]
                out.append((*counts, sp.digest(base, KINDS), sp.written_spans(all_spans, KINDS), max(cost, default=0)))
            names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "max_marginal"]
            yield pd.concat([frame[["id"]], pd.DataFrame(out, index=frame.index, columns=names)], axis=1)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), empty_if_null(text).alias("text")).mapInPandas(
        run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_marginal long"
    ).withColumnRenamed("id", id_col)
