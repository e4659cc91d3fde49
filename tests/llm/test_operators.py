"""Each operator against brute force, and over odd rows and empty tables."""

import gzip
import hashlib
import random
import struct
import wave
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from tests.llm.conftest import prose, row
from weft.llm import ann, bpe, lang_id, license_scan, media, near_dedup, packing, sharding, substring_dedup, warc

SF = "/root/testdata/sf0.01"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1 packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    lengths = [min(1024, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(3000)] if seed else [1024, 1, 1023, 600, 600, 424]
    counts = {k: lengths.count(k) for k in set(lengths)}
    runs = packing.plan(counts, groups=24)
    held = {}
    for n, items in runs:
        assert n > 0 and sum(items) <= 1024
        for k in items:
            held[k] = held.get(k, 0) + n
    assert held == counts
    assert sum(n for n, _ in runs) <= 1.02 * sum(lengths) / 1024 + 2
    keys, first, base, offset = packing.places(runs)
    assert len(keys) == len(set(keys.tolist())) and (offset < 1024).all() and (base >= 0).all() and (first >= 0).all()


def check_packed(rows, texts):
    """rows: of pack(); texts: doc_id and text of all documents, ids unique."""
    codec, of, sequences = bpe.Codec.of(), {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, text in texts.items():
        ids = np.array([*codec.slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(of.pop(d), key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and all(p["length"] == 1024 for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not of
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    used = check_packed(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    counts = {}
    for r in rows:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert used == sum(n for n, _ in packing.plan(counts)) <= best_fit_decreasing(counts)


def best_fit_decreasing(counts, size=1024):
    free = [0] * (size + 1)
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            at = next((f for f in range(k, size + 1) if free[f]), None)
            if at is not None:
                free[at] -= 1
            free[(size if at is None else at) - k] += 1
    return sum(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randrange(1, 1025), lambda: int(rng.triangular(200, 1024, 700)), lambda: min(1024, int(rng.lognormvariate(5.5, 1.2)) + 1)][seed % 3]
    counts = {}
    for _ in range(4000):
        k = draw()
        counts[k] = counts.get(k, 0) + 1
    assert sum(n for n, _ in packing.plan(counts)) <= best_fit_decreasing(counts)


def test_pack_odd(odd_docs, no_docs):
    assert packing.pack(no_docs).count() == 0
    rows = packing.pack(odd_docs).collect()
    assert sum(1 for r in rows if r["piece"] == 0) == odd_docs.count()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


# 2 WARC


@pytest.fixture(scope="module")
def pages(spark):
    same, small = "<p>" + "x" * 200, "tiny"
    rows = [(3, "u3", same), (1, "u1", same), (2, "u2", "é" * 60), (4, "u4", small), (5, "u5", small), (6, None, None), (7, "u7", ""), (8, "u8", same), (None, "u9", same), (10, "u\r\nX: y", "z" * 100_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages, tmp_path):
    found = {r["page_id"]: r for r in warc.read_pages(spark, warc.write_pages(pages)).collect()}
    assert len(found) == 10
    for r in pages.collect():
        data, got = (r["html"] or "").encode(), found[r["page_id"]]
        assert (got["payload_bytes"], got["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = r["page_id"] in (3, 8, None)
        assert (got["record_type"], got["refers_to"]) == (("revisit", 1) if revisit else ("response", None))


@pytest.mark.parametrize("compress", ["true", "false"])
def test_warc_predicates_and_skipping(spark, pages, tmp_path, compress):
    warc.register(spark)
    path = str(tmp_path / "w")
    warc.records_of_pages(pages).write.format("warc").option("compress", compress).option("file_bytes", 1000).mode("append").save(path)
    read = spark.read.format("warc").option("partition_bytes", 2000)
    df = read.load(path).where("record_type = 'revisit' AND target_uri LIKE 'u%' AND payload_length > 100")
    assert rows_of(df, "target_uri") == [("u3",), ("u8",), ("u9",)]
    assert ") Filter " not in df._jdf.queryExecution().executedPlan().toString()
    assert read.option("payload", "none").load(path).where("payload IS NOT NULL").count() == 0
    big = spark.read.format("warc").load(path).where("payload_length = 100000").first()
    assert bytes(big["payload"]) == b"z" * 100_000 and big["target_uri"] == "uX: y"


def test_warc_foreign_gzip_without_lengths(spark, tmp_path):
    warc.register(spark)
    data = b"".join(gzip.compress(warc.record({"WARC-Type": t, "WARC-Record-ID": f"<{i}>"}, bytes(random.Random(i).randbytes(50_000)))) for i, t in enumerate(["response", "resource", "response"]))
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'response'").orderBy("record_id").collect()
    assert [(r["record_id"], bytes(r["payload"])) for r in rows] == [(f"<{i}>", random.Random(i).randbytes(50_000)) for i in (0, 2)]


def test_warc_commit_clears_lost_attempts(tmp_path):
    writer = warc.WarcWriter({"path": str(tmp_path)})
    batch = warc.pa.RecordBatch.from_pylist([{"record_type": "resource", "record_id": "<1>", "payload": b"x"}])
    writer.write(iter([batch]))  # an attempt whose executor was lost
    done = writer.write(iter([batch]))
    (tmp_path / "part-other.warc.gz.open").write_bytes(b"of another job")
    writer.commit([done, None])
    left = sorted(p.name for p in tmp_path.iterdir())
    assert len(left) == 2 and sum(x.endswith(".warc.gz") for x in left) == 1 and "part-other.warc.gz.open" in left


def test_warc_empty(spark, pages, tmp_path):
    assert warc.read_pages(spark, warc.write_pages(pages.limit(0))).count() == 0


# 3 sharding


def brute_fill(shards, slots):
    """Whole preference lists, walked by turns."""
    orders = []
    for s in shards:
        a, b = sharding.number(f"{s}/start") % slots, sharding.number(f"{s}/step") % (slots - 1) + 1
        orders.append([(a + k * b) % slots for k in range(slots)])
    assert all(sorted(o) == list(range(slots)) for o in orders)
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = i
    return [table[k] for k in range(slots)]


def test_sharding_table():
    shards = [f"n{i}" for i in range(7)]
    assert sharding.fill(shards, 101) == brute_fill(shards, 101)
    full, less = sharding.fill(shards, 1009), sharding.fill(shards[:-1], 1009)
    counts = [full.count(i) for i in range(7)]
    assert max(counts) - min(counts) <= 1
    assert sum(a != b for a, b in zip(full, less, strict=True) if a != 6) < 0.1 * 1009
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_sharding_rows(spark, odd_docs, no_docs):
    got = sharding.place(odd_docs, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(got) == odd_docs.count()
    table = sharding.fill(["a", "b", "c"], 101)
    for r in got:
        slot = None if r["doc_id"] is None else sharding.number(str(r["doc_id"])) % 101
        assert (r["slot"], r["shard"]) == (slot, None if slot is None else "abc"[table[slot]])
    assert sharding.place(no_docs, "doc_id").count() == 0
    plan = sharding.place(odd_docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


# 4 licences


def test_license_base_by_brute_force(spark):
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "Mit-license MIT\nLICENSE; general public license, GENERAL public é license")], "doc_id long, text string")
    docs = docs.union(extra)
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        places, base = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert base <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1


def test_license_rules():
    found = license_scan.rules()
    assert len(found) > 200 and all(len(r.keyword) > 2 for r in found)
    scan = lambda t: license_scan.Scanner().scan(t.encode())[0][5].split(",")
    assert scan("Licensed under the Apache License, Version 2.0") == ["apache", "apache-2.0"]
    assert scan("GNU Lesser General Public License version 2.1") == ["gpl", "lgpl-2.1"]
    assert scan("either version 3 of the License, or (at your option) any later version") == ["gpl-3.0-or-later"]
    assert scan("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert scan("https://creativecommons.org/licenses/by-sa/4.0/") == ["cc-by-sa-4.0"]
    assert scan("nothing to see") == [""]


def test_license_suppression_by_brute_force():
    scanner = license_scan.Scanner()
    texts = ["gnu general public license version 2 of mit license and apache license version 2 0", "bsd 3 clause license bsd license spdx license identifier gpl 2 0 or later", "creative commons attribution share alike 4 0 license"]
    for t in map(str.encode, texts):
        every = sorted(((m.start(), m.end(), r) for r in license_scan.rules() for m in r.pattern.finditer(t)), key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0]))
        kept = []
        for x in every:
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        assert scanner.detections(t) == sorted(kept, key=lambda x: x[:2]) and kept


def test_license_part_overlap_by_stated_rule():
    """A detection goes only if a kept one contains it or overlaps it with higher priority."""
    scanner = license_scan.Scanner()
    assert {x[2].label for x in scanner.detections(b"zlib libpng license version 2")} >= {"zlib", "libpng"}
    rng = random.Random(14)
    parts = [r"a b c", r"b c d", r"c d", r"d e f g", r"f g a", r"a b", r"g a b c", r"b"]
    for _ in range(60):
        found = license_scan.rules("\n".join(f"l{k} | {rng.choice([50, 60, 70])} | {p}" for k, p in enumerate(parts)))
        t = " ".join(rng.choice(["a b c d", "d e f g a", "b c", "f g a b c d", "e"]) for _ in range(6)).encode()
        every = sorted(((m.start(), m.end(), r) for r in found for m in r.pattern.finditer(t)), key=lambda x: (-x[2].priority, x[0] - x[1], x[2].order, x[0]))
        kept = []
        for x in every:
            if not any((y[0] <= x[0] and x[1] <= y[1]) or (y[0] < x[1] and x[0] < y[1] and y[2].priority > x[2].priority) for y in kept):
                kept.append(x)
        assert license_scan.Scanner(found).detections(t) == sorted(kept, key=lambda x: x[:2])


def test_license_odd(odd_docs, no_docs):
    got = license_scan.scan_licenses(odd_docs)
    assert got.count() == odd_docs.count() and got.where("base_labels = 'mit'").count() == 1 and license_scan.scan_licenses(no_docs).count() == 0
    assert got.where("text IS NULL AND n_words = 0 AND first_word IS NULL AND labels = ''").count() == 2


# 5 near duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    ids = sorted(sets)
    comp = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if comp[a] != comp[b] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {d: new if c == old else c for d, c in comp.items()}
    return comp


def near_rows():
    rng = random.Random(3)
    rows, d = [], 0
    for group in range(6):
        base = prose(rng, 60 + 40 * group, 5000).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w.insert(rng.randrange(len(w)), f"n{rng.randrange(10**9)}")
            rows.append((d, " ".join(w)))
            d += 1
    rows += [(d, rows[0][1]), (d + 1, rows[3][1].upper()), (d + 2, "a b c"), (d + 3, "A  b c"), (d + 4, ""), (d + 5, None), (d + 6, "a b d")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "block", "bucket_cost"), [(80, 512, 1.0), (85, 512, 1.0), (85, 5, 1.0), (85, 5, 0.0)])
def test_near_duplicates_by_brute_force(spark, percent, block, bucket_cost, monkeypatch):
    monkeypatch.setattr(near_dedup.meetings, "__defaults__", (block, near_dedup.BLOCK_BYTES, bucket_cost))
    rows = near_rows()
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=percent).collect()}
    want = brute_components(rows, percent)
    assert {d: r["component_id"] for d, r in got.items()} == want and 1 < len(set(want.values())) < len(want) - 10
    assert all(got[d]["n_shingles"] == len(shingles(t)) and got[d]["kept"] == (d == want[d]) for d, t in rows)


def test_confirmed_by_matrix_is_by_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(80)]
    i, j = map(np.asarray, zip(*[(a, b) for a in range(80) for b in range(a + 1, 80)], strict=True))
    want = [100 * len(np.intersect1d(sets[a], sets[b])) >= 40 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert near_dedup.confirmed(sets, i, j, 40).tolist() == want and len(i) > 2000


def test_pruning_bound():
    for n in (32, 96, 160):
        m = near_dedup.least_matches(n, 80, 1e-6)
        assert 0 < m < 0.8 * n and near_dedup.least_matches(n, 80, 1e-2) >= m


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (1, 2, 4, 5, 6)} == {1: 1, 2: 2, 4: 4, 5: 5, 6: 4}
    assert all(not r["kept"] for r in got if r["doc_id"] is None)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    least = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: least[x] for e in edges if e[0] != e[1] for x in e}


# 6 BPE


def test_tree_concatenation():
    codec, rng = bpe.Codec.of(), random.Random(4)
    for k in range(400):
        letters = rng.choice(["ab", "the in", "abcdefgh ", "aaaa", "é世界x", " \n", "01"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 500)))
        text += f"<|endoftext|>{text}" if k % 9 == 0 else ""
        assert codec.encode_tree(text, rng.choice([3, 8, 16, 64])) == codec.slow.encode(text, add_special_tokens=False).ids


def test_tree_concatenation_of_mixed_texts():
    codec, rng = bpe.Codec.of(), random.Random(14)
    for _ in range(600):
        text = "".join(rng.choice(["\n", "\n\n", "  ", " ", "\t", "abc" * rng.randrange(1, 40), "12" * rng.randrange(1, 20), "!?" * rng.randrange(1, 20), "it's", "é" * 30, "\xa0\xa0", " \n" * 20]) for _ in range(rng.randrange(1, 14)))
        assert codec.encode_tree(text, rng.choice([4, 16, 40])) == codec.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [64, bpe.LEAF])
def test_encode_texts(spark, odd_docs, no_docs, leaf):
    assert bpe.encode_texts(no_docs, leaf=leaf).count() == 0
    slow = bpe.Codec.of().slow
    got = bpe.encode_texts(odd_docs, leaf=leaf, ids=True).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        ids = slow.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["source"] == "s"
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(slow.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tree_concatenation_of_contractions_and_signs():
    codec, rng = bpe.Codec.of(), random.Random(24)
    for _ in range(1500):
        text = "".join(rng.choice(["'", "''", "'s", "'ll", "tuff", "s", "l", "ll", "re", "ve", " '", " ", "  ", "\n", "0", "12", "!", "?!", "-" * 9, "é", "世", "界" * 7, "\u0301", "\u0558", "\ua7ce", "\U0003fc3f", "a" * 9, "\U0001f600", "\u200d"]) for _ in range(rng.randrange(2, 60)))
        assert codec.encode_tree(text, rng.choice([3, 5, 12, 30])) == codec.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 50_000, "世界" * 9000, "0123456789" * 5000, "ab1!" * 9000, " " * 40_000, "\n" * 20_000 + "x", "'" * 30_000, "it's " * 8000, "x" * 20_000 + " " * 20_000 + "y" * 20_000])
def test_tree_concatenation_of_unsplit_texts(text):
    codec = bpe.Codec.of()
    assert codec.encode_tree(text, 1000) == codec.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [500, bpe.LEAF])
def test_encode_documents(spark, leaf):
    slow = bpe.Codec.of().slow
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert docs.where(F.octet_length("text") > leaf).count() >= 9
    for r in bpe.encode_texts(docs, leaf=leaf, ids=True).collect():
        assert r["ids"] == slow.encode(r["text"], add_special_tokens=False).ids


def test_query_takes_the_tree(spark):
    from weft.llm.queries import op6_bpe

    slow = bpe.Codec.of().slow
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = slow.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        want = hashlib.sha256(slow.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), want)


# 7 repeated windows


def brute_repeats(texts, window):
    seen = {}
    split = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    kept = [[x for i, x in enumerate(w) if i not in g] for w, g in zip(split, gone, strict=True)]
    return sorted((d, len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for d, (w, k) in enumerate(zip(split, kept, strict=True)))


@pytest.mark.parametrize(("hot", "index_words"), [(4096, 300_000), (2, 300_000), (4096, 50)])
def test_repeats_by_brute_force(spark, hot, index_words):
    rng = random.Random(6)
    passages = [prose(rng, n, 1000) for n in (9, 10, 11, 25, 120)]
    texts = [None, "", "x " * 200, "a b " * 90, "one", passages[4], passages[4], prose(rng, 9, 9)]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng, rng.randrange(0, 40), 30) for _ in range(4)]
        texts.append(("\n" if rng.random() < 0.5 else "  ").join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs, window=10, anchor=3, hot=hot, index_words=index_words)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_repeats(texts, 10), key=repr)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 4, 499), 0)
    index = substring_dedup.FMIndex(text, 6)
    for n in range(1, 7):
        for at in range(0, 490, 7):
            pattern = text[at : at + n]
            low, high = np.zeros(1, np.int64), np.full(1, 500)
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            want = sum((text[k : k + n] == pattern).all() for k in range(500 - n + 1))
            if (pattern > 0).all():
                assert high[0] - low[0] == want


def test_repeats_odd(odd_docs, no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    got = substring_dedup.remove_repeats(odd_docs, kept_text=True).collect()
    assert len(got) == odd_docs.count()
    assert all(r["n_removed"] == (r["n_words"] if r["n_words"] > 1000 else 0) for r in got)


# 8 languages


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    remainder = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4
    model = lang_id.learn(docs.where(remainder != 2))
    assert model.languages == ["de", "en", "es", "fr"] and (model.false < 0.05).all()
    got = lang_id.predict(docs.where(remainder == 2), model).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert right >= 0.97 * len(got) > 100 and all(0 <= r["score"] <= 1 for r in got)


def test_language_filter_has_no_false_negatives():
    import pyarrow as pa

    texts = pa.array(["alpha beta gamma delta", "", None, "12 !", "omega"])
    h, first, count = lang_id.grams(texts)
    table = np.zeros(1 << 12, np.uint64)
    for p in lang_id.positions(h, 1 << 12):
        table[p] |= np.uint64(1)
    model = lang_id.LanguageFilter(["x"], table)
    assert model.predict(texts)[0] == ["x", "und", "und", "und", "x"]
    assert model.predict(texts)[1].tolist() == [1, 0, 0, 0, 1]


def brute_grams(text):
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    data = f" {' '.join(clean)} ".encode()
    return [data[i : i + 5] for i in range(len(data) - 4)]


def brute_places(gram, bits):
    x, full = int.from_bytes(gram, "big"), (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & full
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & full
    x ^= x >> 31
    return {(x >> 32 * i) % bits for i in range(2)}


@pytest.mark.parametrize("sample", [400, 6])
def test_language_by_brute_force(spark, sample):
    """Sample, n-grams, filter, counts and decision, in plain Python."""
    rng, bits = random.Random(17), 1 << 12
    words = {x: ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 8))) for _ in range(30)] for x in ("aa", "bb", "cc")}
    rows = [(d, " ".join(rng.choice(words[x]) + rng.choice(["", ",", " 7"]) for _ in range(rng.randrange(1, 40))), x) for d, x in enumerate(rng.choice(list(words)) for _ in range(40))]
    rows += [rows[0], rows[0], (50, None, "aa"), (51, "no label", None), (None, "Ünder Ünder", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    digests = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text")).collect()}
    filters = {}
    for x in words:
        own = sorted({(digests[d, t], t) for d, t, lang in rows if lang == x and t is not None})[:sample]
        held = {}
        for _, t in own:
            for g in set(brute_grams(t)):
                held[g] = held.get(g, 0) + 1
        filters[x] = set().union(*(brute_places(g, bits) for g, n in held.items() if n >= min(3, len(own))))
    model = lang_id.learn(df, sample=sample, bits=bits)
    assert model.languages == sorted(words)
    for i, x in enumerate(model.languages):
        assert set(np.flatnonzero(model.table[0] >> np.uint64(i) & np.uint64(1)).tolist()) == filters[x]
    for r in lang_id.predict(df, model).collect():
        grams = brute_grams(r["text"])
        shares = []
        for x in model.languages:
            wrong = (len(filters[x]) / bits) ** 2
            hit = sum(brute_places(g, bits) <= filters[x] for g in grams) / max(len(grams), 1)
            shares.append(min(1, max(0, (hit - wrong) / (1 - wrong))))
        letters = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == (model.languages[shares.index(max(shares))] if letters else "und") and r["score"] == pytest.approx(max(shares) if letters else 0)


def test_long_texts_count_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x" * 300]) for _ in range(3000))
    h, _, _ = lang_id.grams(pa.array([text]))
    table = np.zeros(1 << 14, np.uint64)
    for p in lang_id.positions(h[: len(h) // 2], 1 << 14):
        table[p] |= np.uint64(1)
    model = lang_id.LanguageFilter(["a"], table)
    hits, count = model.counts(pa.array([text]))
    monkeypatch.setattr(lang_id, "PIECE", 5000)
    part_hits, part_count = model.counts(pa.array([text]))
    assert abs(int(part_count[0]) - int(count[0])) <= 0.01 * count[0] and abs(int(part_hits[0, 0]) - int(hits[0, 0])) <= 0.01 * hits[0, 0]


def test_many_and_rare_languages(spark):
    """More languages than a mask has bits, some of one or two labelled rows."""
    rng = random.Random(12)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(150)}
    said = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(j, said(x, 60), x) for j, x in enumerate(x for k, x in enumerate(words) for _ in range((1, 2, 5)[k % 3]))]
    model = lang_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == sorted(words) and model.table.shape == (3, lang_id.BITS)
    asked = spark.createDataFrame([(j, said(x, 15), x) for j, x in enumerate(words)], "doc_id long, text string, lang string")
    got = lang_id.predict(asked, model).collect()
    assert len(got) == 150 and all(r["lang_pred"] == r["lang"] and r["score"] > 0.3 for r in got)


def test_language_odd(odd_docs, no_docs):
    model = lang_id.learn(odd_docs.where("lang IS NOT NULL"))
    got = lang_id.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["text"] is None or not any(c.isalpha() for c in r["text"]))
    none = lang_id.learn(no_docs)
    assert {r["lang_pred"] for r in lang_id.predict(odd_docs, none).collect()} == {"und"} and lang_id.predict(no_docs, model).count() == 0


# 9 neighbours


def brute_neighbours(rows, queries, k):
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in {i: v for i, v in good if i in queries}.items():
        found = sorted(((-(v * x).sum(), i) for i, v in good if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def vectors(seed=7, n=900):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(60)]
    return rows + [(5000, None), (5020, [0.0] * 8), (5040, [1.0, float("nan")] + [0.0] * 6), (5060, [1.0, None] + [0.0] * 6), (5080, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (5100, [1.0] * 3), (5120, [])]


def test_neighbours_exact_and_recall(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = {i for i, _ in rows if i is not None and i % 20 == 0}
    want = brute_neighbours(rows, queries, 20)
    for factor in (1.0, ann.FACTOR):
        got = {}
        for r in ann.search(df, df.where("vec_id % 20 = 0"), shard=200, block=20, leaf=16, factor=factor).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got.keys() == want.keys()
        if factor == 1:
            assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in ann.search(df, df.where("vec_id % 10 = 0"), k=7, shard=64, block=8, leaf=8, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    held = {i: np.asarray(v, np.float64) for i, v in rows}
    want = {q: sorted((i for i in held if i != q and len(held[i]) == len(held[q])), key=lambda i: (-(held[i] * held[q]).sum(), i))[:7] for q in range(0, 400, 10)}
    assert got == want


@pytest.mark.parametrize(("shard", "leaf"), [(10_000, 1000), (10_000, 16), (100, 16)])
def test_neighbours_with_many_ties(spark, shard, leaf):
    """Hundreds of different vectors of one score, in one leaf, over leaves and over shards."""
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, *rng.integers(-9, 9, 5).astype(float).tolist()]) for i in rng.permutation(400).tolist()]
    rows += [(1000 + i, [0.5, *rng.normal(size=5).tolist()]) for i in range(200)] + [(5000, [1.0] + [0.0] * 5), (5001, [0.0, 1.0] + [0.0] * 4)]
    rows += [(7000, [1.0, 2.0] + [0.0] * 4)] * 60  # a repeated id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.search(df, df.where("vec_id >= 5000 AND vec_id < 7000 OR vec_id = 7"), k=30, shard=shard, block=2, leaf=leaf, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    held = [(i, np.asarray(v, np.float32).astype(np.float64)) for i, v in rows]
    for q in (7, 5000, 5001):
        x = next(v for i, v in held if i == q)
        want = sorted((-float(np.cumsum(v * x)[-1]), i) for i, v in held if i != q)[:30]
        assert got[q] == [(i, -s) for s, i in want]
    assert [i for i, _ in got[5000]] == list(range(30))


def test_neighbours_odd(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 0.0]), (21, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = rows_of(ann.search(df, df.where("vec_id % 20 = 0")), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 21, 2.0), (0, 2, 20, 1.0), (20, 1, 21, 2.0), (20, 2, 0, 1.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


# 10 media


def test_media(spark, odd_docs, no_docs):
    assert media.media_columns(no_docs).count() == 0
    got = media.media_columns(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        data = (r["text"] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        stored = bytes(r["media"])
        assert stored[:4] == b"RIFF" and struct.unpack("<I", stored[4:8])[0] == len(stored) - 8
        assert media.from_wav(stored) == payload and len(payload) % 576 == 0
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(data), len(payload), len(stored), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
    same = {}
    for r in got:
        assert same.setdefault(r["text"] or "", r["feature"]) == r["feature"]
    assert wave


def naive_pairs(payload):
    """Peak pairs frame by frame, by sums of sines and cosines."""
    k, bins = np.arange(576), []
    turns = 2 * np.pi * np.outer(np.arange(1, 289), k) / 576
    for at in range(0, len(payload) - 575, 288):
        x = (np.frombuffer(payload[at : at + 576], np.uint8).astype(float) - 128) * (0.5 - 0.5 * np.cos(2 * np.pi * k / 575))
        power = np.hypot((x * np.cos(turns)).sum(axis=1), (x * np.sin(turns)).sum(axis=1))
        tops = [f for f in range(1, 287) if power[f] > power[f - 1] and power[f] >= power[f + 1]]
        bins.append([f + 1 for f in sorted(tops, key=lambda f: -power[f])[:3]])
    return sorted((t, a << 20 | b << 8 | d) for t in range(len(bins)) for d in (1, 2, 3) if t + d < len(bins) for a in bins[t] for b in bins[t + d])


def test_fingerprints_by_naive_transforms(spark, monkeypatch):
    rng = random.Random(21)
    texts = [prose(rng, n) for n in (0, 1, 100, 700, 2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_columns(docs).collect():
        got, want = [(p["time"], p["code"]) for p in r["pairs"]], naive_pairs(media.from_wav(bytes(r["media"])))
        assert got == want and r["feature"].split(":")[1] == str(len(want))
    monkeypatch.setattr(media, "BLOCK", 7)
    times, codes = media.fingerprint(media.padded(texts[-1].encode()))
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == naive_pairs(media.padded(texts[-1].encode()))


def test_fingerprint_finds_tones():
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(2 * np.pi * 40 * t / 576)).astype(np.uint8).tobytes()
    bins = media.peaks(tone)
    assert (bins[:, 0] == 40).mean() > 0.9
    times, codes = media.fingerprint(tone)
    assert len(times) == len(codes) > 0 and (np.diff(times) >= 0).all() and {40} == set((codes[(codes >> 20 == 40) & (codes & 255 == 1) & (codes >> 8 & 4095 == 40)] >> 20).tolist())


def test_rows_keep_extra_columns(spark):
    df = spark.createDataFrame([row(1, "Some text of the MIT License")], "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, sequence_id string, slot int, kept string, feature string")
    for out in (license_scan.scan_licenses(df), media.media_columns(df), bpe.encode_texts(df), substring_dedup.remove_repeats(df), sharding.place(df, "doc_id")):
        assert {"source", "lang", "n_chars"} <= set(out.columns) and len(out.columns) == len(set(out.columns)) and out.first()["source"] == "s"
