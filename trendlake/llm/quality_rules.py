"""Quality rules with host verdicts: documents, their hosts, and back.

Every document is measured by expressions inside the JVM. Rule failures are
counted per host, a host's failure rate is shrunk towards the other hosts' by
a beta prior estimated from all hosts, and the verdict on each host is joined
back to its documents.

Null text has no words, null hosts form the host "". Repeated rows count once
each. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm.tables import WHITE, empty_if_null, written

SYMBOLS = "#*$%&|<>"
#: Soft limits, as in published web-corpus filters.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
MIN_LINES_FOR_DUP_RULE = 4
MEAN_WORD_LENGTH = (2.0, 20.0)
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.6
#: The prior never weighs less than this many documents, so one document can't set its host's rate.
LEAST_STRENGTH = 2.0


def _windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, in order."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated(sorted_windows: Column, n: Column) -> Column:
    """Positions of windows that stand next to an equal one in sorted order."""
    def equal(i: Column, j: Column) -> Column:
        return F.get(sorted_windows, j)["w"] == F.get(sorted_windows, i)["w"]

    return F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.coalesce(equal(i, i - 1), F.lit(False)) | F.coalesce(equal(i, i + 1), F.lit(False)),
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    t = empty_if_null(text)
    df = df.withColumn("_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    df = df.withColumn(
        "_lines", F.filter(F.split(t, "\n"), lambda line: F.translate(line, WHITE, "") != "")
    ).withColumn("_w", _windows(F.col("_words")))
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    )
    df = df.withColumn(
        "_at",
        F.when(
            F.col("_s").isNotNull(),
            F.transform(_repeated(F.col("_s"), F.size("_s")), lambda k: F.get(F.col("_s"), k)["i"]),
        ),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(
        *[c for c in df.columns if c not in ("_words", "_lines", "_w", "_s", "_at")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_at").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def rules() -> tuple[Column, Column]:
    """Whether the base rules fail, and how many of the soft rules do."""
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    soft = [
        F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n,
        (F.col("n_lines") >= MIN_LINES_FOR_DUP_RULE) & (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines")),
        (F.col("word_chars") < MEAN_WORD_LENGTH[0] * n) | (F.col("word_chars") > MEAN_WORD_LENGTH[1] * n),
    ]
    return base, sum((r.cast("int") for r in soft), F.lit(0))


def host_rates(measured: DataFrame, host: str = "host") -> DataFrame:
    """Per host: documents, failed documents and the failure rate under an empirical beta prior.

    The prior's mean is the pooled rate; its strength is the moment estimate
    for shares from groups of unequal size. With no more spread between hosts
    than chance gives, the strength is the number of all documents, so that
    every host takes the pooled rate.
    """
    hosts = written(
        measured.groupBy(host).agg(
            F.count(F.lit(1)).alias("host_docs"),
            F.sum((F.col("base_failed") | (F.col("soft_failures") > 0)).cast("long")).alias("host_failed"),
        )
    )
    pool = hosts.agg(
        F.sum("host_docs").cast("double").alias("n"), F.sum("host_failed").cast("double").alias("f"),
        F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("n2"),
        F.sum(F.col("host_failed").cast("double") * F.col("host_failed") / F.col("host_docs")).alias("f2"),
        F.count(F.lit(1)).cast("double").alias("k"),
    )
    m = F.col("f") / F.col("n")
    spread = F.col("f2") - F.col("n") * m * m
    chance = m * (1 - m)
    rho = F.try_divide(spread - chance * (F.col("k") - 1), chance * (F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1)))
    strength = F.when(rho > 0, F.greatest(F.try_divide(F.lit(1.0), rho) - 1, F.lit(LEAST_STRENGTH))).otherwise(F.col("n"))
    prior = pool.select(F.struct(m.alias("m"), F.coalesce(strength, F.col("n")).alias("s")).alias("p")).scalar()
    return hosts.withColumn("_p", prior).select(
        host, "host_docs", "host_failed",
        ((F.col("host_failed") + F.col("_p.m") * F.col("_p.s")) / (F.col("host_docs") + F.col("_p.s"))).alias("host_rate"),
    )


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: measures, base_failed, soft_failures, its host's rate, and kept.

    A document is kept if it fails no rule and its host is not rejected. The
    measures are written once, as hosts and documents both read them; the
    host table is broadcast only where its real size allows.
    """
    measured = measure(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), empty_if_null(host).alias("host")), "_text")
    base, soft = rules()
    measured = written(
        measured.drop("_text").withColumn("base_failed", base).withColumn("soft_failures", soft)
    )
    rates = written(host_rates(measured))
    return measured.join(rates, "host", "left").select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "soft_failures", "host", "host_docs", "host_failed", "host_rate",
        (~F.col("base_failed") & (F.col("soft_failures") == 0) & (F.col("host_rate") <= HOST_LIMIT)).alias("kept"),
    )


def kept_rows(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that ``quality_verdicts`` keeps, judged row by row without use of an id.

    Texts are measured twice, for the hosts and for the rows, so that they
    are not written between; only the rejected hosts are.
    """
    base, soft = rules()

    def judged(rows: DataFrame) -> DataFrame:
        measured = measure(rows.withColumn("_host", empty_if_null(host)).withColumn("_text", F.col(text)), "_text")
        return measured.withColumn("base_failed", base).withColumn("soft_failures", soft)

    rejected = written(host_rates(judged(df.select(text, host)), "_host").filter(F.col("host_rate") > HOST_LIMIT).select("_host"))
    own = judged(df.select(F.struct(*df.columns).alias("_row"), F.col(text), F.col(host))).withColumn("_at", F.monotonically_increasing_id())
    # a filter that reads the row number stays above the measures, which pushing it down would repeat for every use
    passed = (F.col("_at") >= 0) & ~F.col("base_failed") & (F.col("soft_failures") == 0)
    kept = own.filter(passed).join(rejected, "_host", "left_anti")
    return kept.select("_row.*")
