"""Winnowing, whitening and phrase mining against slow versions of the same definitions."""

import random
import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendlake.llm import phrases, whitening, winnowing
from trendlake.llm import quotient_filter as qf
from trendlake.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, found string, run long"


# winnowing

def grams_of(text, k, w):
    def h(gram):
        v = xxhash.xxh64_intdigest(gram.encode("utf-32-be"), seed=42)
        return (v - (1 << 64) if v >> 63 else v) >> 14

    if len(text) < k:
        return [(0, h(text))] if text else []
    all_grams = [h(text[i : i + k]) for i in range(len(text) - k + 1)]
    out = []
    for s in range(max(1, len(all_grams) - w + 1)):
        window = all_grams[s : s + w]
        at = s + max(i for i, v in enumerate(window) if v == min(window))
        if not out or out[-1][0] != at:
            out.append((at, all_grams[at]))
    return out


def odd_texts(seed=3):
    rng = random.Random(seed)
    sizes = [0, 1, 4, 5, 11, 12, 13, 29, 60, 99, 100, 101, 1100, 1130, 3000]
    made = ["".join(rng.choice("ab c\U0001f600é") for _ in range(n)) for n in sizes for _ in range(3)]
    return [None, "", "a", "x" * 5000, "ab" * 700, *made, made[-1], made[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 5 else None, t, "en", "mine", 1) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, rows[-1], rows[6], (7, "other text of id seven", None, None, None)], DOCS)


@pytest.mark.parametrize("k,w", [(5, 8), (25, 76), (3, 1)])
def test_selected_grams_are_the_window_minima(docs, k, w):
    for r in docs.select("text", winnowing.selected(F.col("text"), k, w).alias("f")).collect():
        assert [tuple(e) for e in r["f"]] == grams_of(r["text"] or "", k, w)


@pytest.mark.parametrize("k,w,run", [(5, 8, 4), (25, 76, 64)])
def test_fingerprints_of_edited_texts_and_next_rows(docs, k, w, run, monkeypatch):
    monkeypatch.setattr(winnowing, "RUN", run)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]

    def order(row):
        return (row[0] is None, -(row[0] or 0), (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64_intdigest(row[1], seed=42)))

    rows.sort(key=order)

    def write(found):
        return ",".join(f"{p}:{h & ((1 << 50) - 1):x}" for p, h in found)

    def alike(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, following = (grams_of(x, k, w) for x in (t, edited, after))
        want.append((i, len(t), sha256(edited.encode()).hexdigest(), write(own), write(changed), alike(own, changed), alike(own, following)))
    got = [tuple(r) for r in winnowing.fingerprints(docs, k=k, w=w).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_shared_passages_are_matched_with_their_positions(spark):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = made(winnowing.K + winnowing.W - 1)
    rows = spark.createDataFrame([(made(400) + passage + made(90), made(33) + passage + made(700))], "a string, b string")
    r = rows.select(winnowing.selected(F.col("a")).alias("a"), winnowing.selected(F.col("b")).alias("b")).first()
    found = {(x["position"] - 400, y["position"] - 33) for x in r["a"] for y in r["b"] if x["hash"] == y["hash"]}
    assert found and all(a == b for a, b in found)


def test_fingerprints_of_few_rows(spark, docs):
    assert winnowing.fingerprints(docs.filter("false")).collect() == []
    one = winnowing.fingerprints(docs.filter("text = 'a'").limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 1


# whitening

VECTORS = "vec_id long, embedding array<float>, x string, id int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, [None if c is None else float(c) for c in v] if v is not None else None, "x", 0) for i, v in rows], VECTORS)


def whole(v):
    return np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(500, 40)) @ np.diag(np.geomspace(5, 0.05, 40)) + rng.normal(size=40)
    return [(i, data[i]) for i in range(400)] + [(None, data[400]), (3, data[3])]


def test_whitening_equals_the_eigendecomposition(spark, vectors):
    odd = [(900, None), (901, [None] * 40), (902, [np.nan] + [0.0] * 39), (903, [np.inf] + [0.0] * 39), (904, [1.0, 2.0]), (905, []), (906, [1e30] * 40)]
    got = whitening.whiten(table_of(spark, vectors + odd)).collect()
    x = np.array([whole(v) for _, v in vectors])
    n, s = len(x), x.sum(axis=0)
    a = (n * x - s) / n
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == n * 32
    by_row = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9)
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    w = a @ axes[:, :32] / np.sqrt(e[:32])
    mine = {(i, int(((n * row - s).astype(object) ** 2).sum())): z for (i, _), row, z in zip(vectors, x, w)}
    assert set(by_row) == set(mine)
    flip = np.ones(32)
    for at, (key, z) in enumerate(sorted(mine.items(), key=repr)):
        values = np.array([v for _, v in sorted(by_row[key])[:: len(by_row[key]) // 32]])
        if at == 0:
            flip = np.sign(values * z)
        assert values * flip == pytest.approx(z, rel=1e-6, abs=1e-8)


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 6)) * 20
    rows = [(i, [*np.round(v), 7.0, np.round(v)[0]]) for i, v in enumerate(flat)]
    x = np.array([whole(v) for _, v in rows])
    rank = np.linalg.matrix_rank(x - x.mean(axis=0))
    got = whitening.whiten(table_of(spark, rows)).collect()
    assert len(got) == 60 * rank and max(r["identity_error"] for r in got) < 1e-6
    assert whitening.whiten(table_of(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect() == []
    assert whitening.whiten(table_of(spark, [])).collect() == []
    assert {r["component"] for r in whitening.whiten(table_of(spark, [(1, [2.0]), (None, [5.0])])).collect()} == {1}


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(10, np.array([5, 0]), np.array([3, 0]), np.eye(2), np.ones(2), 2.0, 1)
    x = np.array([[5, 0], [2**52, 1], [5 + 2**27, 2**27]])
    want = [sum((10 * int(v) - s) ** 2 for v, s in zip(row, (53, 0))) for row in x]
    assert model.deviation(x) == [want[0], None, want[2]]


def test_triangular_solve_over_panels():
    rng = np.random.default_rng(0)
    upper = np.triu(rng.normal(size=(150, 150))) + 20 * np.eye(150)
    rows = rng.normal(size=(30, 150))
    assert whitening.solved(rows, upper) @ upper == pytest.approx(rows, abs=1e-10)


# quotient filters

@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.data())
def test_filters_give_keys_and_counts_back(bits, data):
    top = (1 << bits) - 1
    lists = data.draw(st.lists(st.lists(st.one_of(st.integers(0, top), st.integers(0, min(top, 5))), max_size=60), min_size=1, max_size=4))
    cuts = data.draw(st.integers(0, min(bits, 3)))
    merged = Counter()
    for keys in lists:
        for part, raw in qf.sliced(np.array(keys, dtype=np.uint64), bits, cuts):
            values, counts = qf.unpacked(raw, bits - cuts)
            assert (np.diff(values.astype(object)) > 0).all()
            back = qf.restored(values | np.uint64(part << (bits - cuts)), bits) if cuts else qf.restored(values, bits)
            for k, c in zip(back.tolist(), counts.tolist()):
                merged[k] += c
    assert merged == Counter(k for keys in lists for k in keys)


def test_large_counts_survive():
    values = np.arange(5, dtype=np.uint64)
    for big in (1, 127, 128, 40_000, 2**40):
        got, counts = qf.unpacked(qf.packed(values, np.array([1, 1, big, 2, 1]), 10), 10)
        assert got.tolist() == [0, 1, 2, 3, 4] and counts.tolist() == [1, 1, big, 2, 1]


# phrases

def slow_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, text or ""
        low = text.translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    key = (lang, tuple(words[i : i + m]))
                    counts[key] = counts.get(key, 0) + 1
    found = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in found.items():
        cover = max((b for (g, q), b in found.items() if g == lang and len(q) > len(p)
                     and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))), default=0)
        if 100 * cover >= 80 * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))
        )
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    )


@pytest.fixture(scope="module")
def sayings():
    rng = random.Random(6)
    names = ["Alpha", "beta", "GAMMA", "delta", "ε", "naïve", "z z"]
    rows = [(rng.choice(["en", "fr", None, ""]), "".join(rng.choice(names) + rng.choice([" ", "  ", "\t", ", ", "\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", " .,!"), ("en", "one two three four five " * 90), ("de", "kurz")]
    return rows + rows[:5]


@pytest.mark.parametrize("block,entries", [(1 << 22, 1 << 19), (100, 64)])
def test_collocations_equal_the_slow_version(spark, sayings, monkeypatch, block, entries):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "MERGE_ENTRIES", entries)
    df = spark.createDataFrame([(t, g, 1, "s") for g, t in sayings], "text string, lang string, n int, word string")
    got = phrases.collocations(df, min_count=12, top=40).collect()
    assert sorted(tuple(r) for r in got) == slow_collocations(sayings, 12, 40)


def test_collocations_where_nothing_is_frequent(spark, sayings):
    df = spark.createDataFrame([(t, g) for g, t in sayings], "text string, lang string")
    for some in (df.filter("false"), df.filter("text is null"), df.filter("text = 'kurz'"), df.limit(20)):
        assert phrases.collocations(some, min_count=100_000).collect() == []
    alone = spark.createDataFrame([("a " * 40, "en")], "text string, lang string")
    assert [r["phrase"] for r in phrases.collocations(alone).collect()] == ["a a a a"]


def test_sql_of_collocations_equals_the_slow_version(sayings):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", sayings)
    names = "lang, rank, phrase, a, l, r, n, score"
    got = con.execute(f"SELECT {names} FROM ({ORACLES['op13_collocations'].strip()})").fetchall()
    assert sorted(got) == slow_collocations(sayings, 30, 2000)
