"""Alignment against token by token links of every document."""

import base64
import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from weft.llm import alignment
from weft.llm.queries import op11_cross_tokenizer_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    vocab = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    entry = {i: bytes(of[c] for c in t) for t, i in vocab.items() if i != 50256}
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert entry == ranks

    def cut(text):
        if not text:
            return [], []
        a = [(i, entry[i]) for i in slow.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            p = pieces.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    return cut


def brute(cut, docs):
    """docs: (doc_id, text) rows. The expected rows, in their order."""
    found, held = [], Counter()
    for _, text in docs:
        a, b = cut(text)
        ends_a, ends_b = (np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b))
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, x) + 1, ends_b.index(end, y) + 1
            groups.append(([t for t, _ in a[x:i]], [t for t, _ in b[y:j]]))
            x, y = i, j
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (d, _), (n_a, n_b, groups, links) in zip(docs, found, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((d, n_a, n_b, len(groups), len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held, Counter(x for f in found for x in f[3])


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, tokenizers):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op11_cross_tokenizer_alignment(spark, SF)) == sorted(brute(tokenizers, docs)[0], key=repr)


ODD = ["", None, " ", "  two  spaces ", "tab\tand\nline\r\n\r\n", "▁ not lossless", "<|endoftext|> <s> </s> <unk> <0x41>", "世界は広い 世界", "naïve ﬁ ① é İ", "😀 👩‍👩‍👧", "a" * 9000, "q9Zx" * 700, "\x00\x01", "don't won't I'LL", "  x", "0️⃣ 12345678901"]


@pytest.mark.parametrize("block", [1, 60, 4_000_000])
def test_odd_texts_copies_and_blocks(spark, tokenizers, block):
    rng = random.Random(block)
    docs = list(enumerate(ODD)) + [(100 + i, prose(rng, rng.randrange(40), 30)) for i in range(30)] + [(7, "the same text")] * 3 + [(None, "of no id"), (None, None), (300, "".join(rng.choice("aeé世 \n'▁"[:-1]) for _ in range(400)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS kind", "2 AS block").repartition(4)
    found = alignment.Alignment(df, block=block)
    want, held, occurrences = brute(tokenizers, docs)
    assert rows_of(found.documents()) == sorted(want, key=repr)
    pairs = {(r["a"], r["b"]): r for r in found.pairs().collect()}
    assert {k: r["n_docs"] for k, r in pairs.items()} == dict(held) and {k: r["n_links"] for k, r in pairs.items()} == dict(occurrences)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    assert all(r["best"] == (r["n_docs"] == best[a]) for (a, _), r in pairs.items())


def test_very_long_text(spark, tokenizers):
    docs = [(1, prose(random.Random(1), 60_000)), (2, "short")]
    assert rows_of(alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), block=1000)) == sorted(brute(tokenizers, docs)[0], key=repr)


def test_groups_of_one_hash_are_told_apart(tokenizers, monkeypatch):
    texts = [prose(random.Random(i), 50, 20) for i in range(6)]
    want = alignment.Block(alignment.Pair.of(), texts)
    monkeypatch.setattr(alignment, "mix", lambda x: x * 0)
    got = alignment.Block(alignment.Pair.of(), texts)
    assert got.digests(got.dictionary()) == want.digests(want.dictionary()) and len(got.first) == len(want.first) > 20


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
