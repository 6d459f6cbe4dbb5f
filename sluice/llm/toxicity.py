"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digits that stand for letters become the
Latin letters they imitate. Entries are word beginnings; an exception phrase that covers a match cancels it. The
weights of the matches, alone and relative to the text's length, give the score. Entries and weights are learned from
a bounded sample of labelled rows, beside a small built-in list.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

#: Labelled rows that are learned from at most: toxic and clean ones, of SAMPLE_CHARS at most.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 5000, 30_000
#: Lengths of learned word beginnings, beside whole words of any length; toxic rows that an entry must be found in; its least log odds.
SHORTEST, STEM, LEAST_ROWS, LEAST_ODDS = 4, 9, 5, 2.5
THRESHOLD = 0.5

#: Words that are insults anywhere, and phrases in which they are not (fixed values).
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "white elephant", "idiot proof", "idiot-proof", "sore loser")
_BUILT_IN_WEIGHT = 4.0

#: Look-alikes of Latin letters (fixed values): Cyrillic, Greek, then digits and signs for letters. l, i and 1 are one.
_LOOKALIKE = (
    "а a в b е e к k м m н h о o р p с c т t у y х x ѕ s і i ј j һ h ԁ d ԛ q ԝ w ɡ g ı i ѵ v "
    "α a β b ε e ζ z η n ι i κ k μ u ν v ο o ρ p τ t υ u χ x γ y "
    "0 o 1 i 3 e 4 a 5 s 7 t @ a $ s € e l i"
).split()


def _folding() -> dict[int, str]:
    table = {ord(a): b for a, b in zip(_LOOKALIKE[::2], _LOOKALIKE[1::2], strict=True)}
    for k in range(26):  # fullwidth letters
        plain = "abcdefghijklmnopqrstuvwxyz"[k]
        table[0xFF41 + k] = table.get(ord(plain), plain)
    for c in (0x200B, 0x200C, 0x200D, 0xAD, 0x2060, 0xFEFF):
        table[c] = ""  # invisible marks inside words
    return table


_FOLD = _folding()
_ASCII = {k: v for k, v in _FOLD.items() if k < 128}
_ASCII_FOLD = bytes(ord(_ASCII.get(b, chr(b))) for b in range(128)) + bytes(range(128, 256))
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower().encode().translate(_ASCII_FOLD).decode()
    return text.lower().translate(_FOLD)


class Lexicon:
    """entries: folded word beginning -> weight; curve: bias and the weights of the two features."""

    def __init__(self, entries: dict[str, float], curve: tuple[float, float, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.entries, self.curve = entries, curve
        self.automaton = ahocorasick.Automaton()
        for entry, weight in entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            if (own := fold(phrase)) not in entries:
                self.automaton.add_word(own, (len(own), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the matches that count: the heaviest beginning of each word, outside exception phrases."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        excepted: list[tuple[int, int]] = []
        for last, (n, weight) in self.automaton.iter(folded):
            start = last + 1 - n
            if start and folded[start - 1].isalnum():
                continue
            if weight is None:
                excepted.append((start, last + 1))
            elif start not in best or best[start][1] < weight:
                best[start] = (last + 1, weight)
        found = [(a, b, w) for a, (b, w) in best.items()]
        return [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in excepted)] if excepted else found

    def features(self, text: str) -> tuple[float, float]:
        """Weight of all matches, and per hundred words, each by its logarithm."""
        folded = fold(text)
        total = sum(w for _, _, w in self.matches(folded))
        if not total:
            return 0.0, 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, len(folded.split())))

    def score(self, text: str) -> float:
        x, y = self.features(text)
        z = self.curve[0] + self.curve[1] * x + self.curve[2] * y
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _learn_entries(toxic: list[str], clean: list[str]) -> dict[str, float]:
    """Word beginnings and whole words that toxic rows have and clean ones lack; each adds rows that shorter lists don't cover."""
    heads = lambda w: [*(w[:k] for k in range(SHORTEST, min(STEM, len(w)) + 1)), *([w] if len(w) > STEM else ())]
    rows_of: dict[str, list[int]] = defaultdict(list)
    for i, text in enumerate(toxic):
        for h in {h for w in set(_WORDS.findall(fold(text))) for h in heads(w)}:
            rows_of[h].append(i)
    rows_of = {h: r for h, r in rows_of.items() if len(r) >= LEAST_ROWS}
    among: Counter = Counter()
    for text in clean:
        among.update({h for w in set(_WORDS.findall(fold(text))) for h in heads(w) if h in rows_of})
    odds = {h: math.log((len(r) + 0.5) / (len(toxic) + 1)) - math.log((among[h] + 0.5) / (len(clean) + 1)) for h, r in rows_of.items()}
    good = [h for h in rows_of if odds[h] >= LEAST_ODDS]
    good.sort(key=lambda h: (-len(rows_of[h]) * odds[h], -len(h), h))
    covered: Counter = Counter()
    out: dict[str, float] = {}
    for h in good:
        if any(h[:k] in out for k in range(SHORTEST, len(h))):
            continue
        if sum(1 for i in rows_of[h] if covered[i] < 2) >= 3:
            out[h] = min(6.0, odds[h])
            covered.update(rows_of[h])
    return out


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, label): entries from two thirds of the rows, the curve from all of them. Without both classes, the built-in list alone."""
    built_in = {fold(w): _BUILT_IN_WEIGHT for w in INSULTS}
    lists = [[t for t, y in rows if y == k] for k in (0, 1)]
    if not all(lists):
        return Lexicon(built_in, (-4.0, 2.0, 0.5))
    own = [[t for i, t in enumerate(x) if i % 3] or x for x in lists]
    lexicon = Lexicon(_learn_entries(own[1], own[0]) | built_in, (0, 0, 0))
    x = np.array([(1.0, *lexicon.features(t)) for t, _ in rows])
    y = np.array([float(k) for _, k in rows])
    held = np.array([1.0 if n % 3 == 0 else 0.3 for n in range(len(rows))])
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps of a logistic curve, held near zero by a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (held * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3)
        beta += np.clip(np.linalg.solve(h, x.T @ (held * (y - p)) - 0.05 * beta), -4, 4)
    return Lexicon(lexicon.entries, tuple(float(b) for b in beta))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> list[tuple[str, int]]:
    """(text, label) of a bounded number of labelled documents of each class, chosen by a hash of doc_id, never held-out ones."""
    from .quality_net import pick

    return pick(docs, labels, "toxic", {1: toxic, 0: clean}, SAMPLE_CHARS)


def _scores(lexicon_parts: tuple) -> callable:
    lexicon = Lexicon(*lexicon_parts)
    return lambda texts: [lexicon.score(t) for t in texts]


def classify(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null texts count as empty; a text without matches has the curve's base score. Rows are independent: repeated rows
    give repeated results, an empty table none; whole texts are matched; other columns are ignored.
    """
    parts = (lexicon.entries, lexicon.curve)
    found = common.map_texts(docs, ["doc_id"], ["score"], "doc_id long, score double", lambda: _listed(_scores(parts)))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _listed(score: callable) -> callable:
    return lambda texts: [score(texts)]


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted clean, with all their columns.

    Null and empty texts have the curve's base score, very long ones are matched whole. Rows are independent, so ties
    and repeated rows stay or go together; an empty table stays empty.
    """
    common.ready(docs.sparkSession)
    parts, at = (lexicon.entries, lexicon.curve), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scores(parts)
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(at), "").to_pylist()
            yield batch.filter(pa.array([s < threshold for s in score(texts)], pa.bool_()))
        common.give_back()

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classify(docs, learn(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
