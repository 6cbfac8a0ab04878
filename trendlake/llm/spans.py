"""Typed spans of a text: their order, digest and written form."""

from __future__ import annotations

from hashlib import sha256

#: kind, start, end (code points, end exclusive)
Span = tuple[str, int, int]


def written_spans(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind in the given order, then end, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return sha256(written_spans(spans, kinds).encode()).hexdigest()


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every stretch that spans cover replaced by the kind of its first span."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
