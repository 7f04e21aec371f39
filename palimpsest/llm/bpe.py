"""Byte-pair encoding by a compiled automaton over tokens.

The merges of a public tokenizer are compiled, in order, into a deterministic automaton: there is a
state for each token (what was read last) and an arc labelled with each token that may follow. At first
there are only bytes and every byte may follow every byte. The gadget of merge ``r: a b -> c`` then
changes three things: the arcs of state ``a`` that read ``b``, or a token that began with ``b`` when
``r`` was applied, are barred; a state ``c`` is added, a copy of state ``b`` as it is at that time; and
arcs labelled ``c`` are added where ``a`` could be read before. Bars are not copied: the copy keeps a
link to its origin and the number of the merge at which it was taken, so the automaton's size is linear
in the merges, and whether an arc exists is found by walking the two links' chains (remembered in a
table afterwards). A sequence of tokens is the encoding of its bytes exactly if the automaton reads it.

Words are bytes, not tokens, so the automaton is run over all ways to read a word at once: for each position
there is exactly one token at which an accepted reading of the bytes before it ends. Which one follows from
the bytes that a token may still take up and the tokens at which readings end before each of them; these are the
states of a second automaton, over bytes, whose transitions are entered in a table when they are first
taken (the subset construction, done as needed). A word is encoded by one step through that table for
each byte, from left to right, and emits the labels of the arcs that lead back from its last state. Decoding joins the labels.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import ship

# Fixed value: the word pattern of byte-level tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII texts, where it takes half the time.
ASCII_WORDS = WORDS.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"[^\s", r"[^\t-\r ").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]").replace("?A-Za-z+", "?[A-Za-z]+").replace("?0-9+", "?[0-9]+")
DEFAULT_FOLDER = "/opt/tokenizers"
#: Words kept in the table of a Python worker before it is begun anew.
WORD_TABLE = 200_000
#: States of the table over bytes before it is begun anew.
STATES = 50_000
NEVER = 1 << 30


_words, _ascii_words = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall


def split_words(text: str | None) -> list[str]:
    """The words of a text, spaces before them included; none for an empty or null one."""
    return (_ascii_words if text.isascii() else _words)(text) if text else []


@cache
def byte_signs() -> dict[str, int]:
    """The printable sign by which vocabulary files write each byte: itself if printable, else one of the signs from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    """The automaton of ``merges`` (pairs of byte strings, in order) with the ids of ``vocabulary``."""

    def __init__(self, vocabulary: dict[bytes, int], merges: Iterable[tuple[bytes, bytes]]):
        self.ids = {label: i for label, i in vocabulary.items() if len(label) == 1}
        self.labels = dict(vocabulary.items())
        size = max(vocabulary.values()) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.alive = [False] * size
        for i in self.ids.values():
            self.alive[i] = True
        self.bar: dict[int, int] = {}
        self.arc: dict[int, bool] = {}
        for r, (a, b) in enumerate(merges):
            self._gadget(r, vocabulary[a], vocabulary[b], vocabulary[a + b], a + b)
        self.arc.clear()
        self.text = {i: label for label, i in vocabulary.items()}
        self.words: dict[str, list[int]] = {}
        self.begun = {label[:i] for label in self.ids for i in range(1, len(label) + 1)}
        self.node_of, self.node, self.goto, self.ending = {b"": 0}, [b""], [{}], [[]]
        self._begin_table()

    def _gadget(self, r: int, a: int, b: int, c: int, label: bytes) -> None:
        # Where a part or the path can't be read, c can't either.
        if self.left[c] < 0 and self.alive[a] and self.alive[b] and self.reads(a, b):
            self.alive[c] = True
            self.left[c], self.right[c], self.born[c] = a, b, r
            self.ids[label] = c
        self.bar.setdefault(a << 32 | b, r)
        self.arc.pop(a << 32 | b, None)

    def reads(self, last: int, token: int) -> bool:
        """Whether state ``last`` has an arc labelled ``token``."""
        key = last << 32 | token
        known = self.arc.get(key)
        if known is None:
            known = self.arc[key] = self._reads(last, token)
        return known

    def _reads(self, last: int, token: int) -> bool:
        bar, left, right, born = self.bar, self.left, self.right, self.born
        until = NEVER  # the copy was taken then: later bars of the origin aren't in it
        while last >= 0:
            begin, gone = token, NEVER  # the token began with this until merge ``gone``
            while begin >= 0:
                r = bar.get(last << 32 | begin)
                if r is not None and r < until and r <= gone:
                    return False
                gone, begin = born[begin], left[begin]
            until, last = born[last], right[last]
        return True

    def _begin_table(self) -> None:
        """The table over bytes with its first state alone. A state has the bytes that a token may still take up, as a node, and the tokens
        at which readings end in front of each of them and after the last (-1 in front of the word)."""
        self.step: list[dict[int, int]] = [{}]
        self.state_of: dict[tuple[int, tuple[int, ...]], int] = {(0, (-1,)): 0}
        self.state: list[tuple[int, tuple[int, ...]]] = [(0, (-1,))]
        self.label, self.width = [-1], [0]

    def _node(self, taken: bytes) -> int:
        """The node of bytes with which a token begins: where each further byte leads, and the tokens that end there, the longest first."""
        found = self.node_of.get(taken)
        if found is None:
            found = self.node_of[taken] = len(self.node)
            self.node.append(taken)
            self.goto.append({})
            ends = ((length, self.ids.get(taken[len(taken) - length :])) for length in range(len(taken), 0, -1))
            self.ending.append([(length, token) for length, token in ends if token is not None])
        return found

    def _arc(self, state: int, byte: int) -> int:
        """Enters the transition of ``state`` at ``byte`` and returns where it leads."""
        node, ends = self.state[state]
        to = self.goto[node].get(byte)
        if to is None:
            taken = self.node[node] + bytes([byte])
            while taken and taken not in self.begun:
                taken = taken[1:]
            if not taken:
                raise KeyError(f"no token for byte {byte}")
            to = self.goto[node][byte] = self._node(taken)
        n = len(self.node[to])
        ends = ends[len(ends) - n :]
        for length, token in self.ending[to]:  # noqa: B007
            last = ends[n - length]
            if last < 0 or self.reads(last, token):
                break
        key = (to, (*ends, token))
        found = self.state_of.get(key)
        if found is None:
            found = self.state_of[key] = len(self.state)
            self.state.append(key)
            self.step.append({})
            self.label.append(token)
            self.width.append(length)
        self.step[state][byte] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the accepted reading of a word."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        if len(self.state) > STATES:
            self._begin_table()
        step, state, trail = self.step, 0, []
        for byte in word:
            to = step[state].get(byte)
            state = self._arc(state, byte) if to is None else to
            trail.append(state)
        out, i, label, width = [], len(word), self.label, self.width
        while i:
            state = trail[i - 1]
            out.append(label[state])
            i -= width[state]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for an empty or null one."""
        if not text:
            return []
        known, out = self.words.get, []
        for word in split_words(text):
            out += known(word) or self._new(word)
        return out

    def count(self, words: list[str]) -> int:
        """The number of ids of a text that has been split into words."""
        known = self.words.get
        return sum([len(known(word) or self._new(word)) for word in words])

    def _new(self, word: str) -> list[int]:
        """The ids of a word that isn't in the table of words, and now is."""
        if len(self.words) >= WORD_TABLE:
            self.words.clear()
        if len(self.arc) > 4_000_000:
            self.arc.clear()
        ids = self.encode_word(word.encode("utf-8"))
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.text[i] for i in ids).decode("utf-8", errors="replace")


def _merges_of_ranks(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of a file of ranks: the last two parts left when lower ranks are applied."""
    out = []
    for label, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(label) < 2:
            continue
        parts = [label[i : i + 1] for i in range(len(label))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)))
            if best[0] >= rank:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def read_vocabulary(content: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Vocabulary and merges of a file: JSON with merges, or lines of a base64 token and its rank."""
    if content.lstrip()[:1] == b"{":
        model = json.loads(content)["model"]
        sign = byte_signs()
        raw = lambda s: bytes(sign[x] for x in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        made = {a + b for a, b in merges}
        vocabulary = {}
        for s, i in model["vocab"].items():
            if all(x in sign for x in s) and (len(s) == 1 or (label := raw(s)) in made):
                vocabulary[raw(s)] = i
        return vocabulary, merges
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    return ranks, _merges_of_ranks(ranks)


@lru_cache(maxsize=4)
def _compiled(content: bytes) -> MergeAutomaton:
    return MergeAutomaton(*read_vocabulary(content))


def tokenizer_file(name: str, folder: str = DEFAULT_FOLDER) -> bytes:
    """The vocabulary file of a byte-level tokenizer, about 1 MB, read on the driver."""
    for end in (".json", ".tiktoken"):
        try:
            with open(f"{folder}/{name}{end}", "rb") as f:
                return f.read()
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"no byte-level vocabulary {name} in {folder}")


def automaton(name: str, folder: str = DEFAULT_FOLDER) -> MergeAutomaton:
    return _compiled(tokenizer_file(name, folder))


class _Worker:
    """Ships the file once to each executor and compiles it once in each Python worker."""

    def __init__(self, spark, name: str, folder: str):
        self.content = ship(spark).sparkContext.broadcast(tokenizer_file(name, folder))

    def get(self) -> MergeAutomaton:
        return _compiled(self.content.value)


def encode_column(df: DataFrame, key: str, text: str, name: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key, ids``: the ids of every text, whole; an empty list for empty and null ones. The order and
    number of rows stay; other columns are ignored."""
    worker = _Worker(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker.get().encode
        for batch in batches:
            found = [encode(x) for x in batch.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_columns(df: DataFrame, key: str, text: str, names: list[str], folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key, tokenizer, n``: for each tokenizer of ``names`` the number of tokens of every text; 0 for empty and null ones. Texts are
    read, and split into words, once for all tokenizers."""
    workers = {name: _Worker(df.sparkSession, name, folder) for name in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [w.get() for w in workers.values()]
        for batch in batches:
            split = [split_words(x) for x in batch.column(1).to_pylist()]
            for name, a in zip(workers, automata, strict=True):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(split), pa.string()), pa.array([a.count(x) for x in split], pa.int32())], names=["key", "tokenizer", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, tokenizer string, n int").withColumnRenamed("key", key)


def decode_column(df: DataFrame, key: str, ids: str, name: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key, text``: the text of every list of ids; empty for an empty or null list."""
    worker = _Worker(df.sparkSession, name, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = worker.get().decode
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "text": [decode(x) if x is not None else "" for x in batch["ids"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)
