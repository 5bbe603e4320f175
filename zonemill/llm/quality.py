"""Quality rules whose cutoffs carry a proven limit on false rejection.

Each rule rejects a text when a measure exceeds a cutoff.  The limit holds for
the verdict of all rules together, in each stratum (the value of a column).  A
path is a set of rules whose cutoffs go from lenient to strict in step.  Along
each path, a step is accepted while the exact (Clopper-Pearson) upper bound of
the share of labelled good documents that any of its rules rejects stays within
``limit``, at confidence ``1 - risk / (strata * paths)``; the first failure ends
the path.  All accepted steps of all paths hold together with ``1 - risk`` (fixed
sequence within a path, Bonferroni over paths and strata), so any may be chosen:
the one that rejects the most documents labelled bad, at a tie the one with
fewest rules, then the most lenient.  A stratum with too few labels rejects
nothing unproven (with the defaults and four strata, 297 good ones are needed).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Measures as SQL over the columns of ``STATS`` and as many cutoffs of each, lenient first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.0, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01)),
    "exclaims": ("n_exclaims / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "capitals": ("n_capitals / greatest(n_letters, 1)", (0.95, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
}
STEPS = 10
#: Each rule alone, then all together: more paths would prove less from as many labels.
PATHS = (*((r,) for r in range(len(RULES))), tuple(range(len(RULES))))
LIMIT, RISK = 0.02, 0.05
#: Cutoff rows up to this many are broadcast; more strata are joined by a shuffle.
BROADCAST_STRATA = 10_000

STATS = (
    "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_exclaims long, n_capitals long, n_letters long"
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more; hashes find candidates, the words decide."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = defaultdict(list)
    for i in np.flatnonzero(np.isin(key, twice)).tolist():
        places[tuple(words[i : i + width])].append(i)
    starts = [i for at in places.values() if len(at) > 1 for i in at]
    cover = np.zeros(len(words) + 1, dtype=np.int32)
    cover[starts] += 1
    np.subtract.at(cover, np.array(starts, dtype=np.int64) + width, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of ``STATS`` after the stratum."""
    if not text:
        return (0,) * 9
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        data.count(b"!"),
        len(data) - len(data.translate(None, _UPPER)),
        len(data) - len(data.translate(None, _LETTERS)),
    )


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts of every whole text (``STATS``); a null text has none of anything."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = zip(*map(measure, batch["text"].to_pylist()))
            columns = [pa.array(list(c), pa.int64()) for c in made] or [pa.array([], pa.int64())] * 9
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["stratum"], *columns], names=names)

    return rows.mapInArrow(run, STATS)


def binomial_tails(k: int, n: int, p: float) -> np.ndarray:
    """P(Bin(n, p) <= i) for i from 0 to k, exactly summed."""
    i = np.arange(k, dtype=np.float64)
    steps = np.log((n - i) / (i + 1)) + (math.log(p) - math.log1p(-p))
    return np.minimum(np.cumsum(np.exp(n * math.log1p(-p) + np.concatenate(([0.0], np.cumsum(steps))))), 1.0)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    return 1.0 if k >= n else float(binomial_tails(k, n, p)[-1])


def allowed(n: int, limit: float, risk: float) -> int:
    """The most false rejections among n whose Clopper-Pearson upper bound, at level ``risk`` (under a half), is at most ``limit``; -1 if none is."""
    # The median of the count is under n * limit + 1, so no larger count can have so small a tail.
    return int(np.count_nonzero(binomial_tails(min(n, math.ceil(n * limit) + 1), n, limit) <= risk)) - 1 if n > 0 else -1


def within(false: int, n: int, limit: float, risk: float) -> bool:
    """True if the Clopper-Pearson upper bound of false/n, at level ``risk``, is at most ``limit``."""
    return false <= allowed(n, limit, risk)


def choose(passed: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, level: float) -> tuple[tuple[int, ...], int]:
    """The rules and the step to use in one stratum; no rules if none is proven or of use.

    ``passed[i, r]`` is how many cutoffs of rule r the documents of cell i stay
    within, from the lenient side; step j rejects a cell where that is at most j.
    """
    most = allowed(int(good.sum()), limit, level)
    best, caught = ((), 0), 0
    for path in PATHS:
        first = passed[:, path].min(axis=1)
        false = np.cumsum(np.bincount(first, good, STEPS + 1))[:STEPS]
        true = np.cumsum(np.bincount(first, bad, STEPS + 1))[:STEPS]
        for step in range(STEPS):
            if false[step] > most:
                break
            if true[step] > caught:
                best, caught = (path, step), true[step]
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """One row for each stratum that has labelled documents: the cutoff of each rule, or infinity.

    A document labelled more than once counts once, as good only if all its
    labels say so, else as bad; labels without a quality or a document are ignored.
    """
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("_good"))
    levels = [F.filter(F.array(*map(F.lit, cs)), _reaches(F.expr(expr))) for expr, cs in RULES.values()]
    names = [f"at_{r}" for r in RULES]
    # At most 11^4 cells for each stratum, whatever the input.
    cells = cut(
        measured.where("not base_failed")
        .join(judged, "doc_id")
        .groupBy("stratum", *(F.size(x).alias(n) for x, n in zip(levels, names)))
        .agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad"))
    )
    level = risk / max(1, cells.select("stratum").distinct().count() * len(PATHS))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        passed = np.stack([table[n].to_numpy() for n in names], axis=1)
        path, step = choose(passed, table["good"].to_numpy(), table["bad"].to_numpy(), limit, level)
        chosen = [[cs[step] if r in path else math.inf] for r, (_, cs) in enumerate(RULES.values())]
        return pa.table([pa.array([key[0].as_py()], pa.string()), *(pa.array(c, pa.float64()) for c in chosen)], names=["stratum", *(f"cut_{r}" for r in RULES)])

    return cells.groupBy("stratum").applyInArrow(run, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def _reaches(value: Column) -> Callable[[Column], Column]:
    return lambda cutoff: value <= cutoff


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``failed_rules`` of every row.

    ``base_failed``: fewer than 10 words, or over a fifth of them in repeated
    5-word windows.  Null and empty texts fail it.  A null stratum is a stratum
    of its own; without labels nothing but the base rejects.  Repeated rows are
    judged each; an empty table gives an empty result; other columns are not read.
    """
    measured = cut(stats(docs, id_col, text_col, stratum_col).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")))
    found = cut(cutoffs(measured, labels, limit, risk)).withColumnRenamed("stratum", "_stratum")
    small = found.count() <= BROADCAST_STRATA
    joined = measured.join(F.broadcast(found) if small else found, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*(F.when(F.expr(f"({expr}) > cut_{rule}"), F.lit(rule)) for rule, (expr, _) in RULES.items())))
    return joined.withColumn("failed_rules", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )
