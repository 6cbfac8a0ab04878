"""The encoder behind packing: work and memory by distinct words, bounded parts of a batch."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendlake.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
HELD = """
import re
from trendlake.llm import packing
import public_tokenizers
code = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
code.encode("a b")
start = held()
for a in range(0, 300_000, 5_000):
    code.encode_all([" ".join(f"w{i:x}{end}" for i in range(a, a + 5_000)) for end in ("", ",", ".")])
print(held() - start)
"""


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.seen = inner, 0

    def __getattr__(self, name):
        def call(texts, **more):
            self.seen += sum(map(len, texts))
            return getattr(self.inner, name)(texts, **more)

        return call if name.startswith("encode_batch") else getattr(self.inner, name)


def test_words_are_tokenized_once_whatever_marks_follow():
    code = packing.WordEncoder(TOKENIZER)
    code.tokenizer = count = Counting(code.tokenizer)
    stems = [f"stem{i:x}" for i in range(2000)]
    text = " ".join(s + m for m in ("", ",", ".", "!!", ")...") for s in stems)
    got = np.frombuffer(code.encode(text), "<u4").tolist()
    assert got == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert count.seen < 1.2 * sum(len(s) + 1 for s in stems)


def test_memory_of_a_worker_follows_its_distinct_words():
    run = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True, timeout=300)
    assert int(run.stdout) < 80


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.sampled_from([" ", "  ", "a", "Zé", "ß", "9", "½", "ǅ", "中", "́", "'", "'s", "’", ",", ".)", "...", "\n", " \n", "\x85", "\xa0", "_", "-", "<|endoftext|>"]),
    st.characters(exclude_categories=["Cs"]),
), max_size=30).map("".join), min_size=1, max_size=5))
def test_marks_and_stems_give_the_ids_of_the_tokenizer(texts):
    whole, code = Tokenizer.from_file(TOKENIZER), packing.encoder(TOKENIZER)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in code.encode_all(texts)] == want


def test_pieces_are_the_same_in_small_parts(spark, monkeypatch):
    texts = [None, "", "one", " two\n", "word, " * 700, "x" * 3000, *(f"text {i}, of a few words." for i in range(200))]
    df = spark.createDataFrame([(None if i == 2 else f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    monkeypatch.setattr(packing, "_BATCH_BYTES", 100)
    out = packing.token_pieces(df, TOKENIZER, length=64, ids=True).orderBy(F.col("doc_id"), "piece").collect()
    found = {}
    for r in out:
        assert r["start"] == sum(x["length"] for x in found.setdefault(r["doc_id"], [])) and r["piece"] == len(found[r["doc_id"]])
        assert len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        found[r["doc_id"]].append(r)
    whole = Tokenizer.from_file(TOKENIZER)
    for i, t in enumerate(texts):
        pieces = found[None if i == 2 else f"d{i}"]
        assert [x for r in pieces for x in r["ids"]] == [*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        assert all(r["length"] == 64 for r in pieces[1:]) and 1 <= pieces[0]["length"] <= 64
