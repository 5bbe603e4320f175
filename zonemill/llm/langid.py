"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language; any other
word scores the mean over its positions of the longest character n-gram known
there, from four characters down to one.  A text's score for a language is the
sum over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_state, give_back, worker_state

#: Training reads about this many labelled rows, chosen by a hash of the id; the model holds every word and n-gram of
#: them, so its size is bounded by this sample whatever the table.
SAMPLE_ROWS = 10_000
#: Characters of the longest n-gram.
LONGEST = 4
#: Scored words that a worker keeps.
CACHE_WORDS = 200_000
#: Rows of a batch that a worker holds as Python texts, and returns, at a time.
SLICE_ROWS = 500

_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def words_of(text: str) -> list[str]:
    """Runs of letters; number-like characters such as ½ are none."""
    words = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ([w] if w.isalpha() else _LETTERS.findall(w))]


def grams_of(word: str) -> Iterator[str]:
    padded = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


@dataclass
class Model:
    """Words and n-grams, each joined by line feeds, and their log frequencies in the order of ``langs``."""

    langs: list[str]
    words: str
    word_rows: np.ndarray
    grams: str
    gram_rows: np.ndarray


def held_out(id_col: Column) -> Column:
    """True for the ids that a model must not learn from; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of labelled texts (l, t): lang, kind, item, n."""
    drop_state()
    seen: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, "w", w, n) for lang, c in seen.items() for w, n in c.items()]
        grams: dict[str, Counter] = {}
        for lang, c in seen.items():
            g = grams.setdefault(lang, Counter())
            for w, n in c.items():
                for x in grams_of(w):
                    g[x] += n
        rows += [(lang, "g", x, n) for lang, c in grams.items() for x, n in c.items()]
        seen.clear()
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "kind", "item", "n"])

    for batch in batches:
        for lang, text in zip(batch["l"].to_pylist(), batch["t"].to_pylist()):
            seen.setdefault(lang, Counter()).update(words_of(text or ""))
        if sum(map(len, seen.values())) > 200_000:
            yield flush()
    if seen:
        yield flush()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Count words and n-grams of about ``sample_rows`` rows that are not held out and have a text and a language.

    Rows are chosen by a hash of their id, so the same rows are chosen every
    time.  Without any labelled row the model has no language.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where(F.col("l").isNotNull() & ~held_out(F.col("i")))
    total = labelled.select("l").count()
    if total > sample_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit("langid"), "i"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))

    # Read three times below, counted once.
    counts = cut(labelled.mapInArrow(_count, "lang string, kind string, item string, n long").groupBy("kind", "item", "lang").agg(F.sum("n").alias("n")))
    sizes = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for _, lang in sizes})
    in_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, lang in enumerate(langs)]
    items = counts.groupBy("kind", "item").agg(F.count("*").alias("in"), *in_lang)

    def table(kind: str) -> tuple[str, np.ndarray]:
        found = items.where(F.col("kind") == kind).toArrow()
        names = found["item"].to_pylist()
        rows = np.empty((len(names), len(langs)), dtype=np.float32)
        for k, lang in enumerate(langs):
            n = found[f"n_{k}"].to_numpy()
            rows[:, k] = np.log(np.maximum(n, 0.5) / (sizes.get((kind, lang), 0) + (n == 0)).clip(1))
        order = sorted(range(len(names)), key=names.__getitem__)
        return "\n".join(names[i] for i in order), rows[order]

    return Model(langs, *table("w"), *table("g"))


class Scorer:
    """Scores texts with a model; unseen words are backed off once and kept."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._start()

    def _start(self) -> None:
        model = self.model
        words = model.words.split("\n") if len(model.word_rows) else []
        self.at = {w: i for i, w in enumerate(words)}
        self.grams = {g: i for i, g in enumerate(model.grams.split("\n") if len(model.gram_rows) else [])}
        self.rows = np.zeros((len(self.at) + CACHE_WORDS + 1, max(1, len(model.langs))))
        if len(words):
            self.rows[: len(words)] = model.word_rows

    def back_off(self, word: str) -> np.ndarray:
        padded, grams = f"<{word}>", self.grams
        used = []
        for i in range(len(padded)):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                known = grams.get(padded[i : i + n])
                if known is not None:
                    used.append(known)
                    break
        return self.model.gram_rows[used].mean(axis=0, dtype=np.float64) if used else np.zeros(self.rows.shape[1])

    def score(self, text: str | None) -> tuple[str, float]:
        """(language, share of its tempered likelihood); ``und`` and 0 without letters or without a model."""
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        total = np.zeros(self.rows.shape[1])
        for lo in range(0, len(words), 100_000):
            part = words[lo : lo + 100_000]
            if len(self.at) + len(part) >= len(self.rows):
                self._start()
            ids = list(map(self.at.get, part))
            if None in ids:
                for k, i in enumerate(ids):
                    if i is None:
                        i = self.at.get(part[k])
                        if i is None:
                            i = self.at[part[k]] = len(self.at)
                            self.rows[i] = self.back_off(part[k])
                        ids[k] = i
            total += self.rows[ids].sum(axis=0)
        scaled = (total - total.max()) / math.sqrt(len(words))
        share = np.exp(scaled)
        best = int(share.argmax())
        return self.model.langs[best], float(share[best] / share.sum())


def _scorer(model) -> Scorer:
    """The worker's scorer of a broadcast model; the model is part of the key, so that another one can't pass for it."""
    return worker_state(("language", model), lambda: Scorer(model.value))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text alone.

    Null texts and texts without letters are ``und`` with score 0; ties go to
    the language first in order; repeated rows are predicted each; other columns
    are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            made = [scorer.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is determined with a score of ``least`` or more.

    Null texts and texts without letters go; texts of any length are scored
    whole; repeated rows are judged each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                made = (scorer.score(t) for t in part[text_col].to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in made], pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)
