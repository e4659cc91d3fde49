"""Vector packing: whole results, limits, padding, and the choice of examples."""

import random
import zlib

import numpy as np
import pytest

from weft.llm import bpe, vector_packing
from weft.llm.queries import op12_vector_packing

SF = "/root/testdata/sf0.01"


def padding(length, size=1024):
    return 0 if length & (length - 1) == 0 else size - length


def check(rows, wanted, tokens, limits):
    """rows: pieces; wanted: key to (ids, bears, part) of each example, keys unique. Returns the lengths of sequences."""
    of, inside = {}, {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
        inside.setdefault(r["sequence_id"], []).append(r)
    assert set(of) == {k for k, v in wanted.items() if len(v[0])}
    for k, own in of.items():
        ids, bears, part = wanted[k]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r[tokens] == len(ids)
            end = at + r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[at:end], "<u4").tobytes())
            assert r["loss_tokens"] == sum(bears[at:end]) and r["segments"] == len(set(part[at:end]))
            at = end
        assert at == len(ids)
    lengths = []
    for own in inside.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits[0] and sum(r["segments"] for r in own) <= limits[1] and sum(r["loss_tokens"] for r in own) <= limits[2]
        lengths.append(at)
    return lengths


def documents(rows):
    codec, out = bpe.Codec.of(), {}
    for d, text in rows:
        ids = [*codec.slow.encode(text or "", add_special_tokens=False).ids, 0]
        out[d] = (ids, [1] * (len(ids) - 1) + [0], [0] * len(ids))
    return out


def test_query_holds_every_id_and_pads_nothing(spark):
    docs = documents((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = op12_vector_packing(spark, SF).collect()
    lengths = check(rows, docs, "doc_tokens", vector_packing.LIMITS)
    assert sum(map(padding, lengths)) == 0
    tokens = sum(len(v[0]) for v in docs.values())
    tasks = len({r["sequence_id"] >> 40 for r in rows})
    assert len(lengths) <= tokens / 1024 + 40 * tasks
    least = sum(-(-len(v[0]) // 1024) for v in docs.values())  # pieces, if each text were cut alone
    assert len(rows) <= least + len(lengths)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 5")
    rows = vector_packing.pack_documents(docs).collect()
    assert sum(map(padding, check(rows, documents((r["doc_id"], r["text"]) for r in docs.collect()), "doc_tokens", vector_packing.LIMITS))) == 0
    every = vector_packing.pack_documents(odd_docs).collect()
    assert sum(r["length"] for r in every if r["doc_id"] is None) == 1 + len(bpe.Codec.of().encode("The MIT License applies")) + 1
    assert sum(r["length"] for r in every if r["doc_id"] == 5) == sum(len(bpe.Codec.of().encode(t)) + 1 for t in ("short", "short", "another text of this id"))
    assert vector_packing.pack_documents(no_docs).collect() == []


def example(rng, key, most, bearing=0.5, parts=3):
    n = rng.randrange(1, most)
    part = np.sort(np.array([rng.randrange(parts) for _ in range(n)]))
    part = np.unique(part, return_inverse=True)[1]
    return vector_packing.Example.of((key,), np.array([rng.randrange(50_000) for _ in range(n)], "<u4"), np.array([rng.random() < bearing for _ in range(n)]), part)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("limits", [(1024, 64, 1024), (1024, 5, 1024), (1024, 64, 300), (256, 2, 100), (1000, 7, 400), (1, 1, 1)])
def test_limits_are_kept_and_every_id_is_placed(whole, limits):
    rng = random.Random(sum(limits))
    examples = [example(rng, k, rng.choice([3, 40, 900, 3000]), rng.random()) for k in range(150 if limits[0] > 1 else 10)]
    kept = {x.key[0]: len(x.ids) for x in examples}
    seen = {}
    for pieces in vector_packing.sequences(iter(examples), limits, whole, pool=40, ahead=20_000):
        total = np.sum([x.demand(a, b) for x, a, b in pieces], axis=0)
        assert (total <= limits).all() and (whole or total[0] == limits[0] or padding(int(total[0]), limits[0]) == 0)
        for x, a, b in pieces:
            seen.setdefault(x.key[0], []).append((a, b))
    for x in examples:
        own = sorted(seen[x.key[0]])
        assert [a for a, _ in own] == [0, *(b for _, b in own[:-1])] and own[-1][1] == kept[x.key[0]]
        if whole and all(a <= b for a, b in zip(x.demand(0, len(x.ids)), limits, strict=True)):
            assert len(own) == 1


def test_the_example_that_uses_what_is_left_is_chosen():
    ids = lambda n: np.zeros(n, "<u4")
    make = lambda key, n, loss: vector_packing.Example.of((key,), ids(n), np.arange(n) < loss)
    # after "a" 500 tokens but only 20 loss-bearing ones are left: of equal lengths the one that spares loss goes in
    pool = vector_packing.Pool((1000, 9, 520), whole=True)
    for x in (make("a", 500, 500), make("b", 400, 100), make("c", 400, 10), make("d", 90, 10), make("e", 300, 60)):
        pool.add(x)
    assert [x.key[0] for x, _, _ in pool.sequence()] == ["a", "c", "d"]


def test_tiny_documents_and_the_segment_limit(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(5000)], "doc_id long, text string").coalesce(1)
    rows = vector_packing.pack_documents(docs).collect()
    lengths = check(rows, documents((r["doc_id"], r["text"]) for r in docs.collect()), "doc_tokens", vector_packing.LIMITS)
    assert sum(map(padding, lengths)) == 0 and np.mean(lengths) > 40


def first_fit_decreasing(demands, limits):
    """Sequences of one task with all examples at hand; what is over a limit counts as the limit."""
    bins = []
    for d in sorted((np.minimum(d, limits) for d in demands), key=lambda d: -d[0]):
        for b in bins:
            if (b + d <= limits).all():
                b += d
                break
        else:
            bins.append(d.copy())
    return len(bins)


def test_instruction_data(spark):
    """Conversations: assistants' turns bear loss, examples stay whole, and the limits on all three hold."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    odd = spark.createDataFrame([(10**9, 0, "user", None), (10**9, 1, "assistant", "word " * 3000), (None, None, None, None), (10**9 + 1, 0, None, "")], "conv_id long, turn int, role string, text string")
    examples = vector_packing.conversation_examples(turns.select("conv_id", "turn", "role", "text").unionByName(odd)).where("conv_id IS NOT NULL").cache()
    own = examples.collect()
    limits = vector_packing.INSTRUCTION_LIMITS
    wanted = {(r["conv_id"], r["turn"]): (r["ids"], r["bears"], r["part"]) for r in own}
    assert len(wanted) == len(own) and sum(len(set(r["part"])) for r in own) == turns.count() + 3
    rows = vector_packing.pack_examples(examples, ["conv_id", "turn"]).collect()
    named = [r.asDict() | {0: (r["conv_id"], r["turn"])} for r in rows]
    lengths = check(named, wanted, "example_tokens", limits)
    cut = {k for k in wanted if sum((r["conv_id"], r["turn"]) == k for r in rows) > 1}
    assert cut == {k for k, (ids, bears, part) in wanted.items() if any(a > b for a, b in zip((len(ids), len(set(part)), sum(bears)), limits, strict=True))}
    tasks = len({r["sequence_id"] >> 40 for r in rows})
    assert len(lengths) <= first_fit_decreasing([(len(i), len(set(p)), sum(b)) for i, b, p in wanted.values()], limits) + 2 * tasks
    assert vector_packing.pack_examples(examples.limit(0), ["conv_id"]).collect() == []


def test_examples_without_marks(spark):
    df = spark.createDataFrame([("x", [1, 2, 3], None, None), ("y", [], None, None), ("z", None, None, None)], "k string, ids array<int>, bears array<boolean>, part array<int>")
    assert [tuple(r)[:1] + (r["length"], r["segments"], r["loss_tokens"], r["example_tokens"]) for r in vector_packing.pack_examples(df, ["k"]).collect()] == [("x", 3, 1, 3, 3)]
