"""Rules of the text operators: every fetch to the driver is named here with its bound."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2] / "trendlake" / "llm"
FETCHES = {
    "ann.py": 1,  # the sample that trains the rotation
    "packing.py": 1,  # counts by piece length, 1024 at most
    "phrases.py": 2,  # two totals
    "pu_quality.py": 3,  # sampled training rows, the prior
    "toxicity.py": 1,  # the labelled sample
    "whitening.py": 3,  # the dimension, its sums, a matrix of its square
}
NATIVE = ("quality_rules.py", "mixing.py", "winnowing.py")


def test_fetches_are_the_named_ones():
    for path in ROOT.glob("*.py"):
        text = path.read_text()
        assert not re.search(r"\.(toLocalIterator|localCheckpoint|crossJoin)\(", text), path
        assert len(re.findall(r"\.(?:toPandas|collect|first)\(", text)) == FETCHES.get(path.name, 0), path


def test_native_operators_stay_in_the_jvm():
    for name in NATIVE:
        assert not re.search(r"udf|\.rdd|mapIn|applyIn|pandas|arrow", (ROOT / name).read_text().split('"""', 2)[2]), name


def test_no_row_at_a_time_functions():
    for path in ROOT.glob("*.py"):
        assert not re.search(r"\bF\.udf\(|\.rdd\b", path.read_text()), path
