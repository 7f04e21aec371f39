"""Abusive, hateful and sexual content: class-conditional Kneser-Ney models over characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import ship

ORDER = 7
#: Orders up to this one are counted over both classes together.
SHARED = 2
#: Most labelled documents of each class that the models are fitted on, and the longest text among them, in characters.
MAX_LABELLED = 4_000
MAX_LABELLED_CHARS = 20_000
#: Toxic labelled documents from which on the threshold is found from the labels.
LEAST_TOXIC = 100
#: Scores from which a passage of a toxic document counts as toxic, for each round of fitting.
ROUNDS = (0.15, 0.4)
#: Log-likelihood ratio a character above which a document is flagged where there are too few labels for finding it.
THRESHOLD = 0.45

# Letters of other scripts, digits and signs that are written for a Latin letter.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u", "ց": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ʏ": "y", "ɪ": "i", "ʀ": "r", "ɴ": "n",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t", "(": "c"}

_LOOKALIKE = str.maketrans(LOOKALIKE)
_LEET = str.maketrans(LEET)
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[a-z0-9@$][.\-_*·•~|/, ]{1,2}){3,}[a-z0-9@$](?![^\W_])|(?<![^\W_])(?:[a-z0-9@$][.\-_*·•~|/]){2,}[a-z0-9@$](?![^\W_])")
_SEPARATORS = re.compile(r"[.\-_*·•~|/, ]")
_LEET_WORD = re.compile(r"[a-z0-9@$!|€]*[a-z][a-z0-9@$!|€]*[0-9@$|€!](?=[a-z0-9@$!|€]*[a-z])[a-z0-9@$!|€]*|[0-9@$€][a-z]{2,}[a-z0-9@$€]*|[a-z]{3,}[0-9@$€](?![\w])")
_REPEAT = re.compile(r"([^\W\d])\1+")
_DIGITS = re.compile(r"\d+(?:[:.,\-]\d+)*")
_SPACE = re.compile(r"\s+")
_IDEOGRAPH = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")
_LATIN_RUN = re.compile(r"[a-z][a-z .'\-]*[a-z]|[a-z]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|(?<=[。！？؟।])|[\r\n  ]+")
_FRAME = re.compile(r'^(?:\[[\d\-: ]+\] [^:\n]{1,40}: |[-*#]+ |\{"[a-z_]+": \d+, "[a-z]+": "|[\d:]+ [A-Z]+ \S+(?: \S+=\S+)* )')


def _unleet(m: re.Match) -> str:
    word = m.group(0)
    digits = sum(c.isdigit() for c in word)
    return word if digits > 3 or digits * 2 > len(word) else word.translate(_LEET)


def normal(text: str) -> str:
    """A text as it sounds: lower case without accents, disguises undone (letters of other scripts and digits that look
    alike, letters set apart or doubled, hidden signs), digits as one 0."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(_LOOKALIKE)
    else:
        text = text.lower()
    text = _SPACED.sub(lambda m: _SEPARATORS.sub("", m.group(0)), text)
    text = _LEET_WORD.sub(_unleet, text)
    text = _DIGITS.sub("0", _REPEAT.sub(r"\1", text))
    return _SPACE.sub(" ", text).strip()


def passages(text: str | None) -> tuple[list[str], list[str]]:
    """The sentences and lines of a text, normalised, and what stands beside them: the frames of lines of logs and transcripts, and
    the Latin runs of Chinese, Japanese or Korean sentences. Those are names, for the most part, that would outweigh the few
    ideographs, where each now stands as one sign. Every character is in some passage."""
    main, beside = [], []
    for part in _SENTENCE.split(text or ""):
        part = part.strip()
        frame = _FRAME.match(part)
        if frame:
            beside.append(normal(frame.group(0)))
            part = part[frame.end() :]
        found = normal(part)
        if len(_IDEOGRAPH.findall(found)) >= 3 and (latin := _LATIN_RUN.findall(found)):
            beside.append(" ".join(latin))
            found = _LATIN_RUN.sub("x", found)
        main.append(found)
    return [p for p in main if p], [p for p in beside if p]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all parts, padded in front of each; which part a character belongs to; and where it counts."""
    lengths = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    pad = "\n" * (ORDER - 1)
    codes = np.frombuffer("".join(pad + p for p in parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(parts), dtype=np.int32), lengths + ORDER - 1), codes != 10


def _keys(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the n-grams that end at each character, for orders 0 to ORDER."""
    key = np.full(len(codes), 7, dtype=np.uint64)
    yield key
    for _ in range(ORDER):
        before = np.empty_like(key)
        before[:1] = 5
        before[1:] = key[:-1]
        key = _mix(before * np.uint64(0xD1342543DE82EF95) + codes + np.uint64(1))
        yield key


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool))


@dataclass
class Level:
    """One order: interpolated log probabilities of the seen n-grams, log backoff weights of their contexts."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    logw: np.ndarray


def _level(types: np.ndarray, counts: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> Level:
    """``types``: sorted distinct n-grams with counts, their contexts, and the lower order's probability of each."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ctx, inverse = np.unique(contexts, return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    kinds = np.bincount(inverse)
    weight = d * kinds / total
    p = (counts - d) / total[inverse] + weight[inverse] * lower
    return Level(types, np.log(p).astype(np.float32), ctx, np.log(weight).astype(np.float32))


class KneserNey:
    """Interpolated Kneser-Ney with the lower orders of a shared pool."""

    def __init__(self, levels: list[Level], floor: float):
        self.levels, self.floor = levels, floor

    def score(self, keys: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        """The log probability of the character at each position of ``where``."""
        out = np.zeros(len(where))
        open_ = np.arange(len(where))
        for n in range(ORDER, 0, -1):
            level = self.levels[n - 1]
            at, hit = _find(level.keys, keys[n][where[open_]])
            out[open_[hit]] += level.logp[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            context = keys[n - 1][where[open_] - 1] if n > 1 else np.full(len(open_), 0, dtype=np.uint64)
            at, hit = _find(level.contexts, context)
            out[open_[hit]] += level.logw[at[hit]]
        out[open_] += self.floor
        return out


def _types(keys: list[np.ndarray], n: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, how often they occur, and a position of each."""
    types, first, counts = np.unique(keys[n][where], return_index=True, return_counts=True)
    return types, counts, where[first]


def _context(keys: list[np.ndarray], n: int, at: np.ndarray) -> np.ndarray:
    return keys[n - 1][at - 1] if n > 1 else np.zeros(len(at), dtype=np.uint64)


def fit(classes: list[list[str]]) -> list[KneserNey]:
    """A model for each class of passages; their orders up to SHARED have the counts of all classes together."""
    floor = float(-np.log(70_000))
    prepared = [_codes(c) for c in classes]
    shared = _levels(np.concatenate([c[0] for c in prepared]), np.concatenate([c[2] for c in prepared]), 1, SHARED, [], floor)
    return [KneserNey(_levels(codes, counts, SHARED + 1, ORDER, shared, floor), floor) for codes, _, counts in prepared]


def _levels(codes: np.ndarray, counts: np.ndarray, first: int, last: int, below: list[Level], floor: float) -> list[Level]:
    """``below`` and the orders ``first`` to ``last`` of a text. The highest order has occurrences; an order below it the number of
    different characters that an n-gram follows. Three orders of keys are held at a time."""
    levels, where = list(below), np.flatnonzero(counts)
    held: list[np.ndarray] = []
    for n, key in enumerate(_keys(codes), -1):  # key is that of order n + 1
        held = [*held[-2:], key]
        if first <= n <= last:
            levels.append(_continued(held, n, where, levels, floor))
        if n == last:
            return levels
    levels.append(_continued([*held[-2:], None], ORDER, where, levels, floor))
    return levels


def _continued(held: list, n: int, where: np.ndarray, below: list[Level], floor: float) -> Level:
    shorter, keys, longer = held
    types, first, counts = np.unique(keys[where], return_index=True, return_counts=True)
    at = where[first]
    if longer is not None:
        _, once = np.unique(longer[where], return_index=True)
        suffixes, kinds = np.unique(keys[where[once]], return_counts=True)
        counts = kinds[np.searchsorted(suffixes, types)]
    if n == 1:
        lower, context = np.full(len(types), np.exp(floor)), np.zeros(len(at), dtype=np.uint64)
    else:
        # The n-gram without its first character is a key of the order below, at the same position.
        found, hit = _find(below[n - 2].keys, shorter[at])
        lower, context = np.where(hit, np.exp(below[n - 2].logp[found]), np.exp(floor)), shorter[at - 1]
    return _level(types, counts.astype(np.float64), context, lower)


class Scorer:
    """Compares the models of toxic and ordinary passages."""

    def __init__(self, toxic: KneserNey, ordinary: KneserNey, threshold: float = THRESHOLD, prior: int = 12):
        self.toxic, self.ordinary, self.threshold, self.prior = toxic, ordinary, threshold, prior

    def passages(self, parts: list[str]) -> np.ndarray:
        """The length-normalised log-likelihood ratio of each passage; very short ones are drawn to 0."""
        if not parts:
            return np.zeros(0)
        at: dict[str, int] = {}
        where = [at.setdefault(p, len(at)) for p in parts]
        return self._distinct(list(at))[where]

    def _distinct(self, parts: list[str]) -> np.ndarray:
        out, start, size = [], 0, 0
        for i, p in enumerate(parts, 1):
            size += len(p) + ORDER
            if size > 300_000 or i == len(parts):
                out.append(self._some(parts[start:i]))
                start, size = i, 0
        return np.concatenate(out)

    def _some(self, parts: list[str]) -> np.ndarray:
        codes, part, counts = _codes(parts)
        keys, where = list(_keys(codes)), np.flatnonzero(counts)
        ratio = self.toxic.score(keys, where) - self.ordinary.score(keys, where)
        total = np.bincount(part[where], weights=ratio, minlength=len(parts))
        n = np.bincount(part[where], minlength=len(parts))
        return total / (n + self.prior)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The highest score among a text's passages; that of a text without any is the lowest, -10."""
        return self.split_documents([passages(t) for t in texts])

    def split_documents(self, parted: list[tuple[list[str], list[str]]]) -> np.ndarray:
        """The same for texts that are split into passages."""
        split = [main + beside for main, beside in parted]
        sizes = np.fromiter((len(s) for s in split), dtype=np.int64, count=len(split))
        each = self.passages([p for s in split for p in s])
        out = np.full(len(split), -10.0)
        np.maximum.at(out, np.repeat(np.arange(len(split)), sizes), each)
        return out


Parted = list[tuple[list[str], list[str]]]


def train(toxic_docs: Parted, ordinary_docs: Parted, rounds: tuple[float, ...] = ROUNDS) -> Scorer:
    """Fits the two models from labelled documents (as passages). Only some passages of a toxic document
    are toxic: after a first fit on all of them, each round keeps the passages that the models tell apart and counts the others as ordinary.
    What stands beside the sentences of a toxic document tells nothing and is left out."""
    ordinary = [p for d in ordinary_docs for part in d for p in part]
    toxic = [p for main, _ in toxic_docs for p in main]
    pool, rest = toxic, []
    for least in rounds:
        scores = Scorer(*fit([pool, ordinary + rest])).passages(toxic)
        keep = scores > least
        if not keep.any():
            break
        pool = [p for p, k in zip(toxic, keep, strict=True) if k]
        rest = [p for p, k in zip(toxic, keep, strict=True) if not k]
    return Scorer(*fit([pool, ordinary + rest]))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, text, toxic, of, drawn`` of at most ``most`` labelled documents of each class, none longer than
    ``MAX_LABELLED_CHARS``, drawn by hash; ``drawn`` of the class's ``of`` documents. A
    document's class is that of most of its opinions; null opinions and ties are left out."""
    votes = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.avg((F.col("label") != "none").cast("double")).alias("share")).where("share <> 0.5")
    found = documents.select("doc_id", "text").where(f"trim(text) <> '' and length(text) <= {MAX_LABELLED_CHARS}").join(votes, "doc_id").select("doc_id", "text", (F.col("share") > 0.5).alias("toxic"))
    sizes = found.groupBy("toxic").agg(F.count("*").alias("of")).withColumn("drawn", F.least("of", F.lit(most)))
    draw = lambda toxic: found.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "text").limit(most)
    return draw(True).unionByName(draw(False)).join(F.broadcast(sizes), "toxic").select("doc_id", "text", "toxic", "of", "drawn")


def best_threshold(scores: np.ndarray, toxic: np.ndarray, weight: float = 1.0) -> float:
    """The middle of the thresholds that separate the classes with hardly more than the fewest mistakes (2 % and one more), where a
    flagged ordinary document counts ``weight`` mistakes."""
    order = np.argsort(scores, kind="stable")
    scores, toxic = scores[order], toxic[order]
    # Mistakes if all after the i-th are flagged: toxic ones up to it, ordinary ones behind it.
    wrong = np.cumsum(toxic) + weight * ((~toxic).sum() - np.cumsum(~toxic))
    good = np.flatnonzero(wrong <= wrong.min() * 1.02 + 1)
    upper = scores[min(good[-1] + 1, len(scores) - 1)]
    return float((scores[good[0]] + upper) / 2)


def fit_scorer(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Scorer | None:
    """The models of a bounded sample of labelled documents, fitted on the driver; None if a class is missing. The threshold is found from the
    same documents, each half scored by models fitted on the other half, and ordinary ones counting for those that weren't
    drawn; it is ``THRESHOLD`` where there are under ``LEAST_TOXIC`` toxic ones."""
    sample = labelled_sample(documents, labels, most)
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.text))
    split = [passages(r.text) for r in rows]
    toxic = np.array([r.toxic for r in rows], dtype=bool)
    if toxic.all() or not toxic.any():
        return None
    of = lambda which: [split[i] for i in np.flatnonzero(which)]
    threshold = THRESHOLD
    if toxic.sum() >= LEAST_TOXIC:
        half = np.zeros(len(rows), dtype=bool)
        for which in (toxic, ~toxic):
            half[np.flatnonzero(which)[1::2]] = True
        scores = np.zeros(len(rows))
        for here in (half, ~half):
            scores[here] = train(of(toxic & ~here), of(~toxic & ~here)).split_documents(of(here))
        drawn = {r.toxic: r.of / r.drawn for r in rows}
        threshold = best_threshold(scores, toxic, drawn[False] / drawn[True])
    scorer = train(of(toxic), of(~toxic))
    scorer.threshold = threshold
    return scorer


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float | None = None, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, source, score, flagged`` of every document, by its whole text.

    Two character models are fitted (``fit_scorer``): of toxic and of ordinary passages, with Kneser-Ney
    smoothing whose lower orders are shared, so that what neither class has seen tells nothing. A passage's score is the
    log-likelihood ratio a character, and a document's that of its worst passage; it is flagged above ``threshold``, by default that
    of the held-out labels.
    Texts are compared without their disguises (``normal``). Null and blank texts score -10; where
    the labels lack a class, scores are null and nothing is flagged.
    """
    scorer = fit_scorer(documents, labels, most)
    wanted = documents.select("doc_id", "source", "text")
    if scorer is None:
        return wanted.select("doc_id", "source", F.lit(None).cast("double").alias("score"), F.lit(False).alias("flagged"))
    sent = ship(documents.sparkSession).sparkContext.broadcast(scorer)  # its size is bounded by that of the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = sent.value
        for b in batches:
            for i in range(0, len(b), 500):
                x = b.iloc[i : i + 500]
                yield pd.DataFrame({"doc_id": x["doc_id"], "source": x["source"], "score": judge.documents([t if isinstance(t, str) else None for t in x["text"]])})

    scored = wanted.mapInPandas(run, "doc_id bigint, source string, score double")
    return scored.withColumn("flagged", F.col("score") > (scorer.threshold if threshold is None else threshold))


def rates(scored: DataFrame) -> DataFrame:
    """By source: documents, flagged ones, and their share. A null source is one of its own."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged_documents")).withColumn("flagged_share", F.round(F.col("flagged_documents") / F.col("documents"), 6))
