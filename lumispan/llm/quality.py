"""Quality rules with risk-controlled thresholds.

Fixed base rules come first (too few words; mostly repeated 3-word windows). Five signals may reject
further documents, by one joint rule for each stratum (language; base rules are fixed and bear no guarantee): a document is rejected when any
signal reaches its cutoff. One half of the labelled rows proposes the cutoffs; all of them, raised by
one common number of bins, make a sequence of nested rules. The other half tests these from the
loosest to the strictest by the exact binomial tail (a fixed sequence, which needs no correction) at
level ``delta / groups`` (Bonferroni). The strictest certified rule bounds the false rejections of
good documents in that stratum by ``alpha``, with probability ``1 - delta`` over all strata together.

A stratum is small where a single false rejection among its good holdout rows could not be certified.
Two or more small strata are pooled: they get one rule, and the bound holds for them taken together,
not for each. Groups are formed from row counts only. Where nothing can be certified, as in a small
stratum that has no other to pool with, nothing is rejected.

Defined results: a null text has no words and fails the base rules; a null language is a stratum of
its own; labels of null ids or null quality are ignored, and of several labels the lowest counts;
repeated rows are judged alike; an empty table gives an empty result. Extra columns stay, and an
input column named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, every, quoted, release, scratch, small_batches, stored

SIGNALS = ("symbols", "dup_lines", "repeats", "upper", "bars")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BINS = 64
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, each word counted once."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def measure(text: bytes) -> tuple:
    """COUNTS, then SIGNALS in [0, 1], of a whole text in UTF-8."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats = repeat_words(words)
    upper = len(text) - len(text.translate(None, CAPITALS))
    return n, chars, symbols, dup, repeats, min(1.0, symbols / max(1, n)), dup / max(1, lines), repeats / max(1, n), upper / max(1, chars), text.count(b"|") / max(1, n + text.count(b"|"))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with COUNTS (long) and SIGNALS (double)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join([*(f"{c} long" for c in COUNTS), *(f"{s} double" for s in SIGNALS)]))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in batches:
                rows = [measure(b"" if t is None else bytes(t)) for t in texts]
                yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate((*COUNTS, *SIGNALS))}).astype({c: "int64" for c in COUNTS} | {s: "float64" for s in SIGNALS})
        finally:
            release()

    made = scratch(docs, "_measured")
    out = docs.withColumn(made, measured(quoted(text_col).cast("string").cast("binary")))
    return out.select(*every(docs, (*COUNTS, *SIGNALS)), f"{made}.*")


def base_failed():
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_bin(good_tune: list[int], bad_tune: list[int], good_hold: list[int], alpha: float, level: float) -> int | None:
    """The lowest rejected bin (a signal in bin b or above is rejected), or None.

    Lists count rows by bin. The tuning half proposes the bin with the largest excess of rejected bad
    over rejected good shares; the holdout then certifies bins downward from the top, one by one.
    """
    n, bad, good = sum(good_hold), sum(bad_tune), sum(good_tune)
    if not n or not bad or not good:
        return None
    best, want = 0.0, None
    b = g = 0
    for at in range(BINS, 0, -1):
        b, g = b + bad_tune[at], g + good_tune[at]
        if b / bad - g / good > best:
            best, want = b / bad - g / good, at
    if want is None:
        return None
    rejected, certified = 0, None
    for at in range(BINS, want - 1, -1):
        rejected += good_hold[at]
        if rejected > alpha * n or binomial_tail(rejected, n, alpha) > level:
            break
        certified = at
    return certified


def propose(good: list[int], bad: list[int], alpha: float) -> int | None:
    """A signal's cutoff by the tuning half's rows by bin, or None where it rejects too few bad rows.

    A share ``alpha`` of the good rows weighs as much as all bad ones; of equal cutoffs the highest is taken.
    """
    n_good, n_bad = sum(good), sum(bad)
    best, want, g, b = alpha, None, 0, 0
    for at in range(BINS, 0, -1):
        g, b = g + good[at], b + bad[at]
        if n_good and n_bad and b / n_bad - g / (alpha * n_good) > best:
            best, want = b / n_bad - g / (alpha * n_good), at
    return want


def _by_bin(rows: pd.DataFrame) -> list[int]:
    out = [0] * (BINS + 1)
    for at, n in zip(rows["bin"], rows["n"]):
        out[int(at)] += int(n)
    return out


def fit(measured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", label_col: str = "quality", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, one lowest rejected bin for each signal or null), from all labelled rows.

    ``measured``: features with id and stratum. Only counts by (stratum, signal, bin) and by (stratum, joint bin) are gathered.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good"))
    hold = F.pmod(F.xxhash64(F.lit(29), F.col("_id")), F.lit(2)) == 1
    passed = measured.filter(~base_failed()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("\0")).alias("stratum"), *(_bin(s).alias(s) for s in SIGNALS))
    marked = stored(passed.join(marks, "_id").select("stratum", hold.alias("hold"), (F.col("_good") > 0).alias("good"), *SIGNALS))
    sizes = stored(marked.groupBy("stratum").agg(F.count_if(F.col("hold") & F.col("good")).alias("n")))
    strata = max(1, sizes.count())
    # P(X <= 1) for X ~ Binomial(n, alpha)
    small = F.pow(F.lit(1 - alpha), F.col("n") - 1) * (1 + (F.col("n") - 1) * alpha) > delta / strata
    n_small = sizes.filter(small).count()
    pooled = n_small > 1
    level = delta / (strata - n_small + 1 if pooled else strata)
    in_pool = small & F.lit(pooled)
    groups = stored(sizes.filter(F.lit(pooled) | ~small).select("stratum", F.struct(in_pool.alias("pool"), F.when(in_pool, "").otherwise(F.col("stratum")).alias("name")).alias("group")))
    marked = marked.join(broadcast_if_small(groups), "stratum")
    tuning = marked.filter("not hold").select("group", "good", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("bin")) for s in SIGNALS))).alias("x"))

    def proposed(key, rows):
        found = {f"w_{s}": propose(*(_by_bin(rows[(rows["signal"] == s) & (rows["good"] == g)]) for g in (True, False)), alpha) for s in SIGNALS}
        return pd.DataFrame([{"pool": key[0]["pool"], "name": key[0]["name"]} | found]).astype({f"w_{s}": "Int32" for s in SIGNALS})

    counts = tuning.groupBy("group", "x.signal", "x.bin", "good").agg(F.count("*").alias("n"))
    wanted = stored(counts.groupBy("group").applyInPandas(proposed, "pool boolean, name string, " + ", ".join(f"w_{s} int" for s in SIGNALS)).select(F.struct("pool", "name").alias("group"), *(f"w_{s}" for s in SIGNALS)))
    # a row's joint bin: how far its furthest signal goes beyond the proposed cutoff, 1 at the cutoff, 0 below
    joint = F.greatest(F.lit(0), *(F.col(s) - F.col(f"w_{s}") + 1 for s in SIGNALS))
    scored = marked.join(broadcast_if_small(wanted), "group").groupBy("group", joint.alias("bin"), "hold", "good").agg(F.count("*").alias("n"))

    def choose(key, rows):
        part = lambda h, g: _by_bin(rows[(rows["hold"] == h) & (rows["good"] == g)])
        at = choose_bin(part(False, True), part(False, False), part(True, True), alpha, level)
        return pd.DataFrame([{"pool": key[0]["pool"], "name": key[0]["name"], "at": at}]).astype({"at": "Int32"})

    chosen = scored.groupBy("group").applyInPandas(choose, "pool boolean, name string, at int").select(F.struct("pool", "name").alias("group"), "at")
    rules = stored(chosen.join(wanted, "group").select("group", *((F.col(f"w_{s}") + F.col("at") - 1).alias(f"b_{s}") for s in SIGNALS)))
    return stored(sizes.select("stratum").join(groups.join(rules, "group"), "stratum", "left").select("stratum", *(F.when(F.col(f"b_{s}") <= BINS, F.col(f"b_{s}")).alias(f"b_{s}") for s in SIGNALS)))


def _bin(signal: str):
    return F.least(F.ceil(F.col(signal) * BINS), F.lit(BINS)).cast("int")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept."""
    names = {c: scratch(measured, f"_{c}") for c in cutoffs.columns}
    limits = cutoffs.withColumnsRenamed(names)
    rejected = F.lit(False)
    for s in SIGNALS:
        rejected = rejected | F.coalesce(_bin(s) >= F.col(names[f"b_{s}"]), F.lit(False))
    stratum = F.coalesce(quoted(stratum_col).cast("string"), F.lit("\0"))
    joined = measured.join(broadcast_if_small(limits), stratum == F.col(names["stratum"]), "left")
    return joined.select(*every(measured, ("base_failed", "kept")), base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
