"""Order up to a threshold, against a loop over the slots."""

import random

import pytest

from weft.operators import slop
from weft.plans.merge import Merge, MergeOptions, build_timeline, positioned


def model(rows, threshold):
    """(file, line) in order; rows: (merge_key, file, line)."""
    slots = {}
    for key, file, line in rows:
        slots.setdefault(key // threshold, {}).setdefault(file, []).append(line)
    out, last = [], None
    for s in sorted(slots):
        files = sorted(slots[s], key=lambda f: (f != last, f))
        last = files[-1]
        out += [(f, n) for f in files for n in sorted(slots[s][f])]
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 1), (2, 7), (3, 40), (4, 10**9)])
def test_against_a_loop(spark, seed, threshold):
    rng, rows = random.Random(seed), []
    for file in range(rng.choice([1, 2, 5])):
        at = rng.randrange(50)
        for n in range(300):
            at += rng.choice([0, 0, 1, 3, -2, 60 if rng.random() < 0.05 else 0])
            rows.append((file, n, at if rng.random() < 0.8 else None))
    df = spark.createDataFrame(rows, "file_idx int, line_no bigint, ts_ns bigint").repartition(3)
    timeline = build_timeline(df)
    keyed = [(r["merge_key"], r["file_idx"], r["line_no"]) for r in timeline.collect()]
    got = positioned(timeline, threshold=threshold).orderBy("out_pos").collect()
    assert [(r["file_idx"], r["line_no"]) for r in got] == model(keyed, threshold)
    assert [r["out_pos"] for r in got] == list(range(len(rows)))
    high = 0
    for r in got:  # no line is behind one that is a threshold later
        assert r["merge_key"] > high - threshold
        high = max(high, r["merge_key"])
    with pytest.raises(ValueError, match="threshold"):
        positioned(timeline, threshold=0)


def test_maps_compose():
    rng = random.Random(5)
    for _ in range(200):
        slots = [tuple(sorted(rng.sample(range(5), 2), reverse=True)) if rng.random() < 0.7 else (rng.randrange(5), None) for _ in range(6)]
        for before in (None, *range(5)):
            last = before
            for largest, second in slots:
                last = slop.ends_with(largest, second, last)
            told, equal, other = slots[0][0], slop.ends_with(*slots[0], slots[0][0]), slots[0][0]
            for largest, second in slots[1:]:
                equal, other = slop.ends_with(largest, second, equal), slop.ends_with(largest, second, other)
            assert last == (equal if before == told else other)


def test_fewer_changes_of_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for c in "ab":
        (tmp_path / "in" / f"{c}.log").write_text("".join(f"2031-01-01 00:00:{i:02d}.{500 * (c == 'b'):03d} {c}\n" for i in range(60)))
    changes = {}
    for threshold in (None, 10 * 10**9):
        with Merge(spark, [str(tmp_path / "in")], MergeOptions(threshold=threshold)) as m:
            m.write(str(tmp_path / "out"))
            text = [x[-1] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
            assert text == [x[-1] for x in m.lines()] and sorted(text) == ["a"] * 60 + ["b"] * 60
            changes[threshold] = sum(x != y for x, y in zip(text, text[1:], strict=False))
    assert changes == {None: 119, 10 * 10**9: 6}
