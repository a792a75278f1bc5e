"""Operator 13 against a plain version: groups, links and counts token by token."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import alignment
from graphloom.llm._tokens import runs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "Hello world, it's fine.", " lead", "trail ", "two  spaces   here", "tab\t x\n y \n\n z", "ünï 日本語 テスト x", "▁mark", "a▁b", "<|endoftext|> <s> <0x41> <unk>", "😀😀 naïve", "x", " ", "   ", "\n", "word " * 300, "日本" * 400, "a  b  c", "\x00nul", "é" * 50, "Hello world, it's fine.", "don't can't I'll", "́ comb", "\x1c a \x85 b"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    inverse = {c: x for x, c in _bytes_to_unicode().items()}
    names = {i: t for t, i in a.get_vocab(with_added_tokens=True).items()}

    def tokens(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        raw_x = [bytes(inverse[c] for c in names[i]) for i in x]
        raw_y = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        want = (" " + text).encode()
        if b"".join(raw_x) != want or b"".join(raw_y) != want:
            return [], []
        return list(zip(x, raw_x)), list(zip(y, raw_y))

    return tokens


def _bytes_to_unicode():
    keep = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


def groups_of(x, y):
    """Groups as lists of ids, by walking both sequences."""
    out, i, j = [], 0, 0
    while i < len(x):
        ga, gb, end_a, end_b = [x[i]], [y[j]], len(x[i][1]), len(y[j][1])
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                ga.append(x[i])
                end_a += len(x[i][1])
                i += 1
            else:
                gb.append(y[j])
                end_b += len(y[j][1])
                j += 1
        out.append(([t for t, _ in ga], [t for t, _ in gb]))
    return out


def expected(texts, tokens):
    each = []
    for text in texts:
        x, y = tokens(text)
        each.append((len(x), len(y), groups_of(x, y)))
    df = collections.Counter(p for _, _, g in each for p in {(i, j) for ga, gb in g for i in ga for j in gb})
    most = collections.defaultdict(int)
    for (i, _), n in df.items():
        most[i] = max(most[i], n)
    rows = []
    for n_a, n_b, g in each:
        links = [(i, j) for ga, gb in g for i in ga for j in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        rows.append((n_a, n_b, len(g), len(links), sum(df[p] == most[p[0]] for p in links), sum(df[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return rows


def rows_of(spark, texts, **extra):
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, row__ int").repartition(3)
    got = alignment.link_counts(df, A, B).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [tuple(r[c] for c in names) for r in sorted(got, key=lambda r: r.doc_id)]


def test_alignment_brute(spark, plain, monkeypatch):
    rng = random.Random(3)
    parts = [*"abcXYZ019.,'!?-_<>|", " ", " ", "  ", "\n", "\t", "é", "日", "本", "😀", "the ", "ing", "'s", "▁", " ", "ß", "<|endoftext|>", "http://", "00"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    want = expected(texts, plain)
    assert rows_of(spark, texts) == want
    # counts in many slices, groups paired by distinct ids in small blocks, counts flushed often
    monkeypatch.setattr(alignment, "SLICE", 500)
    assert rows_of(spark, texts[:150]) == expected(texts[:150], plain)


def test_large_groups_pair_distinct_ids(monkeypatch, plain):
    tokens = alignment.load(A, B)
    texts = ["日本語" * 30 + "x", "😀😃 " * 20, "words and more words"]
    whole = alignment.align(tokens.ids(texts), tokens)
    monkeypatch.setattr(alignment, "LARGE", 1)
    monkeypatch.setattr(alignment, "BLOCK", 3)
    for x, y in zip(whole, alignment.align(tokens.ids(texts), tokens), strict=True):
        assert x[:5] == y[:5] and all(np.array_equal(p, q) for p, q in zip(x[5:], y[5:], strict=True))


def test_runs_join_to_the_text():
    for text in filter(None, TEXTS):
        assert " ".join(runs(text)) == text


def test_empty_table(spark):
    assert alignment.link_counts(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_bounded_memory():
    """What a worker holds while it aligns megabytes of text, beside its tokenizers."""
    import random
    import tracemalloc

    import public_tokenizers as P
    import pyarrow as pa

    from graphloom.llm._spark import by_bytes

    rng, tokens = random.Random(3), alignment.load(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choices(words, k=400)) for _ in range(700)])], names=["text"])
    tracemalloc.start()
    try:
        for b in by_bytes([batch], 0, alignment.BYTES):
            alignment.align(tokens.ids(b.column(0).to_pylist()), tokens)
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


def test_parts_are_encoded_many_at_a_time(monkeypatch):
    """Joined parts have the ids that each has alone, whatever they begin and end with; the byte-level tokenizer gets few texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiou'lnrst.,-0é") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    odd = ["", " ", "  x", "x  ", "tab\t", "line\nend\n", "nbsp\u00a0", "a\u2581b", "<|endoftext|>", "中文字", "🙂", "'s", "\u3000", "x\u0301", "\t\ty", "0\x00", "\u00ad", "'", " 's"]
    parts = list(dict.fromkeys([*words[:1500], *odd, *words[1500:]]))
    tokens, asked = alignment.Pair(A, B), []
    alone = [tokens.a.encode(" " + p, add_special_tokens=False).ids for p in parts]

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **options)

    real, tokens.a = tokens.a, Counted()
    ok, ((ids, count), (other, many)) = tokens._encode(parts)
    assert len(asked) < len(parts) / 50
    cut = np.cumsum(count)
    assert [x.tolist() for x in np.split(ids, cut[:-1])] == alone
    assert [x.tolist() for x in np.split(other, np.cumsum(many)[:-1])] == [tokens.b.encode(p) if p else [tokens.b.piece_to_id("▁")] for p in parts]
    assert [p for p, fine in zip(parts, ok) if not fine] == ["a\u2581b"]
    # a tokenizer that joined what it shouldn't: its parts are encoded alone
    monkeypatch.setattr(alignment, "ends_solid", lambda part: True)
    ids, count = tokens._encode_a(parts, [b" " + p.encode() for p in parts])
    assert sum(count) == len(ids) and len(count) == len(parts)
