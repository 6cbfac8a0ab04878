"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, schemes, plus
signs before digits, digits with a dot or another digit beside them, and
identifier cues. Around each anchor a small local parser finds the boundaries
of the candidate and validates it. Matches of one kind never overlap: each
parser goes on where its last match ended, from left to right.

Kinds email, ip, card and phone follow fixed patterns. The method adds
``login`` (user and password in the authority of a URL), ``iban`` (checked
modulo 97) and ``account`` (a number after an account cue).
"""

from __future__ import annotations

import re
import sys

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.llm import spans as sp
from trendlake.llm.tables import empty_if_null

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sp)

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "HTTP://", "HTTPS://", "FTP://")
_CUES = ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IP_RUN = frozenset("0123456789.")
_CARD_RUN = frozenset("0123456789 -")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s/@:]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[ :#.=-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?: ?(?:number|no|nr|num|id)\b)?[ .:#=-]{1,4}([0-9](?:[ -]?[0-9]){5,29})", re.I | re.A)

_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        for d in "0123456789":
            a.add_word(f"+{d}", ("phone", 2))
            a.add_word(f"{d}.", ("ip", 2))
            for e in "0123456789":
                for gap in ("", " ", "-"):
                    a.add_word(f"{d}{gap}{e}", ("card", 2 + len(gap)))
        for s in _SCHEMES:
            a.add_word(s, ("login", len(s)))
        for c in _CUES:
            a.add_word(c, ("iban" if c.lower() == "iban" else "account", len(c)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _run(text: str, at: int, members: frozenset, low: int) -> tuple[int, int]:
    """The longest stretch of ``members`` around ``at``, from ``low`` on."""
    a = at
    while a > low and text[a - 1] in members:
        a -= 1
    b, n = at, len(text)
    while b < n and text[b] in members:
        b += 1
    return a, b


def find_personal(text: str) -> list[sp.Span]:
    """All spans of one text; anchors come from left to right."""
    found: list[sp.Span] = []
    after = dict.fromkeys(KINDS, 0)  # where each kind's parser goes on
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if at < after[kind]:
            continue
        if kind == "email":
            a = at
            while a > after["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, at + 1)):
                found.append(("email", a, m.end()))
                after["email"] = m.end()
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                after["phone"] = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", at, m.end()))
        elif kind == "ip":
            a, b = _run(text, at, _IP_RUN, after["ip"])
            after["ip"] = b
            for m in _IP.finditer(text, a, b):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    found.append(("ip", m.start(), m.end()))
        elif kind == "card":
            a, b = _run(text, at, _CARD_RUN, after["card"])
            after["card"] = b
            for m in _CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", m.start(), m.end()))
        elif kind == "login":
            if m := _LOGIN.match(text, last + 1):
                found.append(("login", last + 1, m.end()))
                after["login"] = m.end()
        elif kind == "iban":
            if m := _IBAN.match(text, last + 1):
                after["iban"] = m.end()
                code = m[1].replace(" ", "")
                if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    found.append(("iban", m.start(1), m.end(1)))
        elif m := _ACCOUNT.match(text, last + 1):
            after["account"] = m.end()
            found.append(("account", m.start(1), m.end(1)))
    return found


def personal_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, base_sha256 over base spans, spans with all kinds.

    Null text is empty: no spans. Rows are independent of each other, so
    repeated rows give repeated results and an empty table an empty one.
    """

    def run(frames):
        for frame in frames:
            out = []
            for t in frame["text"]:
                all_spans = find_personal(t)
                base = [s for s in all_spans if s[0] in BASE]
                counts = [sum(s[0] == k for s in base) for k in BASE]
                out.append((*counts, sp.digest(base, KINDS), sp.written_spans(all_spans, KINDS)))
            yield pd.concat(
                [frame[["id"]], pd.DataFrame(out, index=frame.index, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])], axis=1
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), empty_if_null(text).alias("text")).mapInPandas(
        run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    ).withColumnRenamed("id", id_col)


def mask_personal(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every personal span in ``text`` replaced by its kind in brackets; null text stays null."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else sp.masked(t, find_personal(t)))

    return df.withColumn(text, mask(F.col(text)))
