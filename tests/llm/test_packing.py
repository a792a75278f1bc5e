"""Operator 12: the plan against exhaustive search, pieces against the tokenizer's own ids."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, WORLD 123!", "  two  spaces \n\t lines ", "don't I'll ünï ÅΣΑΣ", "日本語 テスト", "<|endoftext|> x <|startoftext|>", "é ́x", " a b\x1cc\x85d", "Å ŻÓŁĆ ﬁ"]


def best(demand, units):
    """Fewest sequences, by search over all ways to fill one with the longest document left."""
    seen = {}

    def need(left):
        if not any(left):
            return 0
        if left not in seen:
            top = max(c for c, n in enumerate(left) if n)
            seen[left] = 1 + min(need(rest) for rest in fills(tuple(n - (c == top) for c, n in enumerate(left)), units - top))
        return seen[left]

    def fills(left, room):
        options = [c for c in range(1, room + 1) if c < len(left) and left[c]]
        if not options:
            yield left
        for c in options:
            yield from fills(tuple(n - (i == c) for i, n in enumerate(left)), room - c)

    return need(tuple(demand))


def test_patterns_hold_the_demand_near_the_optimum():
    rng = random.Random(5)
    for _ in range(40):
        units = rng.choice([6, 8, 10])
        demand = np.array([0] + [rng.randrange(3) for _ in range(units)])
        patterns, copies = packing.patterns_for(demand, units)
        assert ((patterns * copies[:, None]).sum(axis=0) == demand).all()
        assert (patterns @ np.arange(units + 1) <= units).all()
        assert copies.sum() <= best(demand, units) + 1
    rng = np.random.default_rng(1)
    demand = np.concatenate([[0], rng.integers(0, 100_000, 128)])
    patterns, copies = packing.patterns_for(demand, 128)
    assert ((patterns * copies[:, None]).sum(axis=0) == demand).all()
    # duals under which no pattern is worth over 1 bound the number of sequences from below
    columns, _ = packing.generate_columns(demand, 128)
    duals = np.concatenate([[0], np.linalg.solve(columns[:, 1:].astype(float), np.ones(128))])
    assert packing.knapsack(duals, 128)[0] <= 1 + 1e-9
    assert demand @ duals - 1e-3 <= copies.sum() <= demand @ duals + 130


def test_knapsack_takes_the_most_valuable_pattern():
    rng = np.random.default_rng(2)
    for _ in range(50):
        value = np.concatenate([[0], rng.normal(0.3, 0.3, 9)])
        worth, pattern = packing.knapsack(value, 9)
        assert pattern @ np.arange(10) <= 9 and worth == pytest.approx(pattern @ value)
        most = [0.0] * 10
        for u in range(1, 10):
            most[u] = max([most[u - 1]] + [most[u - c] + value[c] for c in range(1, u + 1)])
        assert worth == pytest.approx(most[9])


def test_ids_equal_the_library(ids_of):
    """Plain words are merged as rows of a matrix, others are the library's."""
    rng, tokens = random.Random(6), packing.load(WORDS, 2)
    some = [chr(c) for c in range(0x250)] + list("日本語ΣΑς’“”…œŒ€́̈ 　ﬁ𝒳😀") + ["'s", "'ll", "<|endoftext|>", " ", "  ", "\n"] * 5
    plain = "abcdefghijklmnopqrstuvwxyzßéüÀÞA'0 .,!<>|\n"
    texts = TEXTS + ["x" * 41, "aaaa" * 10, "The" * 30] + ["".join(rng.choice(c) for _ in range(rng.randrange(60))) for _ in range(3000) for c in (some, plain)]
    texts += [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 14))) for _ in range(400))]
    assert [x.tolist() for x in tokens(texts)] == [ids_of(t) for t in texts]


def check(rows, texts, ids_of, capacity):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for k, text in enumerate(texts):
        ids, at = np.array(ids_of(text), "<u4"), 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            own = ids[at : at + r.length].tobytes()
            assert r.crc == zlib.crc32(own) if "crc" in r else bytes(r.ids) == own
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(WORDS)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("capacity, width, long", [(64, 4, 6), (64, 4, 0), (256, 8, 2), (4096, 32, 1)])
def test_pieces(spark, ids_of, capacity, width, long):
    rng = random.Random(capacity + long)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "B2", "gamma,", "δέλτα", "it's", "x\ny"]) for _ in range(rng.randrange(capacity // 3))) for _ in range(60)] + ["long text " * (3 * capacity)] * long
    df = spark.createDataFrame([(k, t, 1, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n int, key int, part string").repartition(3)
    rows = packing.pack(df, WORDS, 2, capacity, width, "crc").collect()
    assert check(rows, texts, ids_of, capacity) == 0
    # documents that fit are whole, but for those that the stream takes to fill holes
    cut = {r.doc_id for r in rows if r.length < r.doc_tokens <= capacity}
    assert len(cut) <= len(texts) / 3
    if long:
        assert not cut


def test_ids_and_sequences(spark, ids_of):
    texts = TEXTS * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(df, WORDS, 2, 16, 2)
    rows = pieces.collect()
    assert check(rows, texts, ids_of, 16) == 0
    for r in packing.sequences(pieces).collect():
        own = sorted((x for x in rows if x.sequence_id == r.sequence_id), key=lambda x: x.offset)
        assert bytes(r.ids) == b"".join(bytes(x.ids) for x in own) and r.length == sum(x.length for x in own)


def test_odd_tables(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "a b"), (7, "x"), (7, "x")], "doc_id long, text string")
    rows = packing.pack(odd, WORDS, payload="crc").collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows if r.start == 0) == [(False, 2), (False, 2), (True, 1), (True, 3)]
    assert sum(r.length for r in rows) == 8
