import base64
import random

import pytest

from palimpsest.llm import bpe

FOLDER = bpe.DEFAULT_FOLDER
TEXTS = ["".join(random.Random(i).choice("aab bcdee hellothing  \n1 2é中🫖'") for _ in range(i % 70)) for i in range(1500)] + ["a" * k for k in range(1, 60)] + ["<|endoftext|>", " " * 90, "中" * 900, "don't", "İıß"]


def test_same_ids_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    a = bpe.automaton("byte_bpe_50k")
    want = [e.ids for e in t.encode_batch(TEXTS, add_special_tokens=False)]
    assert [a.encode(x) for x in TEXTS] == want
    assert [a.decode(x) for x in want] == TEXTS


def test_ranks_without_merges():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{FOLDER}/byte_bpe_multi_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})
    a = bpe.automaton("byte_bpe_multi_50k")
    assert [a.encode(x) for x in TEXTS] == [e.encode_ordinary(x) for x in TEXTS]


def test_a_small_automaton_against_merging_by_hand():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = {bytes([c]): i for i, c in enumerate(b"abc")}
        merges = []
        for _ in range(12):
            x, y = rng.choice(sorted(vocabulary)), rng.choice(sorted(vocabulary))
            if x + y not in vocabulary:
                merges.append((x, y))
                vocabulary[x + y] = len(vocabulary)

        def by_hand(word):
            parts = [bytes([c]) for c in word]
            for x, y in merges:
                i, out = 0, []
                while i < len(parts):
                    if parts[i : i + 2] == [x, y]:
                        out.append(x + y)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            return [vocabulary[p] for p in parts]

        a = bpe.MergeAutomaton(vocabulary, merges)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert a.encode_word(word) == by_hand(word)


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", None), (4, "a b " * 20_000, "x"), (None, "null id", "x")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, len(r.ids)) for r in bpe.encode_column(df, "doc_id", "text", "byte_bpe_50k").collect()]
    assert sorted(got, key=repr) == sorted([(1, 0), (2, 0), (3, 2), (3, 2), (4, 40_001), (None, 2)], key=repr)
    assert bpe.encode_column(df.limit(0), "doc_id", "text", "byte_bpe_50k").count() == 0
    back = bpe.decode_column(bpe.encode_column(df, "doc_id", "text", "byte_bpe_50k"), "doc_id", "ids", "byte_bpe_50k")
    assert {r.text for r in back.collect()} == {"", "hello world", "a b " * 20_000, "null id"}
