"""The driver's contract."""

import os
import re

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "ts_ns", "merge_key", "out_pos"] and df.count() > 0


def test_keys():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, names in os.walk(f"{ROOT}/weft"):
        if not folder.startswith(f"{ROOT}/weft/llm"):
            for name in names:
                if name.endswith(".py"):
                    with open(f"{folder}/{name}", encoding="utf-8") as f:
                        assert not re.search(r"weft\.llm|corpus_pipeline", f.read()), name
