"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding.

Folding takes accents, joining signs and signs without width away, lowers the case, and maps homoglyphs
to Latin letters and digits and signs that stand for letters to those letters, one character for one;
a sign that may be an i or an l is an i, and words with an l are matched in both spellings. A match
counts where the unfolded text has no letter or digit on either side and no exception phrase covers
it. Words spelt out in single letters, as ``m o r o n``, are matched as well. The score is the weights' sum
over the number of words (runs of non-space characters). A document is toxic with at least ``MIN_HITS``
matches and a score of ``MIN_SCORE``, or with any match and a score of ``SURE_SCORE``.

The lexicon is a seed of insults in four languages, of weight 1, and words learned from all labels:
those much more frequent in toxic than in other labelled documents, of their language and of all.
Words are counted in Spark, once; only the chosen words go to the driver.

Defined results: a null or empty text scores 0 with no hits; a null lang is a language of its own;
rows that repeat are scored each on its own; without labels the seed alone counts. Extra columns of
any name are carried (``without_toxic``) or ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, kept, table

_WORDS = """
idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile vermin asshole bastard dumbass scumbag retard
dummkopf abschaum arschloch trottel schwachkopf vollidiot hurensohn missgeburt drecksack vollpfosten wichser dreckskerl
idiota imbécil estúpido estúpida escoria gilipollas pendejo cabrón asqueroso tarado malnacido
imbécile crétin crétine abruti connard connasse salaud enfoiré minable raclure ordure
"""
SEED = {w: 1.0 for w in _WORDS.split()}
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "pond scum", "sore loser rule")
MIN_SUPPORT, MIN_SHARE, MIN_LOG_ODDS, FULL_LOG_ODDS = 4, 0.04, 3.0, 6.0
MIN_HITS, MIN_SCORE, SURE_SCORE = 2, 0.002, 0.1

_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "!": "i", "|": "i", "+": "t", "2": "z", "6": "g", "9": "g", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}
_FOLD = str.maketrans(_LOOKALIKES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): "oizeasgtbg"[k] for k in range(10)})


_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_SPELT = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*][^\W_]){3,}(?![^\W_])")


def bare(text: str) -> str:
    """Lower case without accents and signs of no width."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


def fold(lowered: str) -> str:
    """A lower-case text with lookalikes and substitutions as letters; its length stays."""
    return lowered.translate(_FOLD)


def spellings(word: str) -> set[str]:
    """A word folded, with each l also as the i that a sign for it is folded to; with more than four l all at once."""
    word = fold(bare(word))
    out = {word, word.replace("l", "i")}
    if word.count("l") <= 4:
        for k, c in enumerate(word):
            if c == "l":
                out |= {w[:k] + "i" + w[k + 1 :] for w in out}
    return out


class Matcher:
    """Finds lexicon words outside exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        self.automaton, self.weights = ahocorasick.Automaton(), {}
        for phrase in exceptions:
            for form in spellings(phrase):
                self.automaton.add_word(form, (len(form), None))
        for word, weight in lexicon.items():
            for form in spellings(word) - {""}:
                self.weights[form] = max(weight, self.weights.get(form, 0))
                self.automaton.add_word(form, (len(form), self.weights[form]))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def hits(self, text: str | None) -> list[float]:
        """The weights of the words that count."""
        if not text or self.empty:
            return []
        low = bare(text)
        found, covered = [], []
        for last, (size, weight) in self.automaton.iter(fold(low)):
            first = last - size + 1
            if (first and low[first - 1].isalnum()) or (last + 1 < len(low) and low[last + 1].isalnum()):
                continue
            (covered if weight is None else found).append((first, last, weight))
        if found and covered:
            covered.sort()
            starts, ends = [c[0] for c in covered], list(accumulate((c[1] for c in covered), max))
            found = [x for x in found if not (k := bisect_right(starts, x[0])) or ends[k - 1] < x[1]]
        return [w for _, _, w in found] + [self.weights[w] for m in _SPELT.finditer(low) if (w := fold("".join(c for c in m[0] if c.isalnum()))) in self.weights]

    def judge(self, text: str | None) -> tuple[float, int, bool]:
        """Score, hits and verdict."""
        hits = self.hits(text)
        if not hits:
            return 0.0, 0, False
        score = math.fsum(hits) / max(1, len(text.split()))
        return round(score, 6), len(hits), (len(hits) >= MIN_HITS and score >= MIN_SCORE) or score >= SURE_SCORE


@lru_cache(maxsize=1 << 17)
def _sign(word: str) -> str:
    """What a word of a text is counted as: folded, without signs around it; empty if there are signs within."""
    word = "".join(c if c.isalnum() else " " for c in fold(bare(word).strip("!|+.,;:?"))).strip()
    return "" if " " in word else word


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, toxic, clean): in how many documents each word is; an empty word counts all."""
    counts: dict[tuple[str | None, bool], Counter] = {}

    def out() -> pa.RecordBatch:
        sums: dict[tuple[str | None, str], list[int]] = {}
        for (lang, toxic), words in counts.items():
            for w, n in words.items():
                sums.setdefault((lang, w), [0, 0])[not toxic] += n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), *(pa.array([v[x] for v in sums.values()], pa.int64()) for x in (0, 1))], ["lang", "word", "toxic", "clean"])

    for batch in batches:
        for lang, text, toxic in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = {_sign(w) for w in set((text.as_py() or "").split())} | {""}
            counts.setdefault((lang, bool(toxic)), Counter()).update(words)
        if sum(map(len, counts.values())) > 500_000:
            yield out()
    yield out()


def learned_lexicon(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Weights of the words that tell labelled toxic documents from the other labelled ones.

    A word needs at least ``MIN_SUPPORT`` toxic documents and ``MIN_SHARE`` of its language's, exact
    copies counted once, and smoothed log odds of ``MIN_LOG_ODDS`` both in its language and in all of
    them, as it is matched in all; at ``FULL_LOG_ODDS`` it weighs 1. The labels are broadcast only where
    they are counted to be few; the lexicon holds at most 1 / MIN_SHARE times the words of a document
    for each language.
    """
    known = kept(labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic")))
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, F.col("doc_id") == F.col("__id")).where("text is not null")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "lang", "toxic"]).select("lang", "text", (F.col("toxic") > 0).alias("toxic"))
    counts = kept(texts.mapInArrow(_word_counts, "lang string, word string, toxic long, clean long").groupBy("lang", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = counts.where("word = ''").select(F.col("lang").alias("of"), F.col("toxic").alias("n_toxic"), F.col("clean").alias("n_clean"))
    whole = counts.groupBy(F.col("word").alias("all_of")).agg(F.sum("toxic").alias("toxic_all"), F.sum("clean").alias("clean_all"))
    sums = whole.where("all_of = ''").select(F.col("toxic_all").alias("n_toxic_all"), F.col("clean_all").alias("n_clean_all"))

    def odds(toxic: str, clean: str, n_toxic: str, n_clean: str) -> Column:
        return F.log((F.col(toxic) + 0.5) / (F.col(n_toxic) + 1)) - F.log((F.col(clean) + 0.5) / (F.col(n_clean) + 1))

    told = counts.where(f"word <> '' and toxic >= {MIN_SUPPORT}").join(totals, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("toxic") >= MIN_SHARE * F.col("n_toxic"))
    told = told.join(whole, F.col("word") == F.col("all_of")).crossJoin(F.broadcast(sums))  # one row
    least = F.least(odds("toxic", "clean", "n_toxic", "n_clean"), odds("toxic_all", "clean_all", "n_toxic_all", "n_clean_all"))
    told = told.select("word", least.alias("odds")).where(F.col("odds") >= MIN_LOG_ODDS).groupBy("word").agg(F.max("odds").alias("odds"))
    return {r["word"]: min(1.0, r["odds"] / FULL_LOG_ODDS) for r in told.collect() if " " not in r["word"]}


def lexicon_for(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    return learned_lexicon(docs, labels) | SEED


def toxicity(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id, score, hits, toxic of every row; one pass, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            judged = [matcher.judge(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in judged], pa.float64()), pa.array([x[1] for x in judged], pa.int32()), pa.array([x[2] for x in judged], pa.bool_())], ["doc_id", "score", "hits", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, hits int, toxic boolean")


def without_toxic(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """The rows that are not toxic, all columns as they are; one pass, no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.judge(x.as_py())[2] for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, lexicon_for(docs, table(spark, sf_dir, "labels")))
