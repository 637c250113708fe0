"""Candidates by rare shingles: tables merged in tasks, and no rows for shingles that one component has alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meritlens.llm import minhash
from meritlens.llm.common import bit_table, maybe_member


def test_values_of_places_are_merged_in_tasks(spark):
    df = spark.range(0, 30_000, 1, 3).select((F.col("id") % 10_000).alias("p"))
    read = lambda b: (b.column("p").to_numpy(), np.ones(len(b), np.int64), b.column("p").to_numpy())
    found = list(minhash._by_place(df, read, [np.add, np.maximum]))
    assert len(found) == -(-10_000 // minhash.BLOCK)
    place, count, most = (np.concatenate(x) for x in zip(*found))
    assert sorted(place) == list(range(10_000)) and set(count) == {3} and (most == place).all()
    assert list(minhash._by_place(df.where("p < 0"), read, [np.add, np.maximum])) == []


def test_only_shingles_of_several_labels_become_rows(spark, monkeypatch):
    same, other = list(range(1, 41)), list(range(1001, 1041))
    rows = [(1, same), (2, same), (3, other), (4, other + [5000])]
    sets = spark.createDataFrame([(i, sorted(x * 0x0123456789AB % (1 << 62) for x in s)) for i, s in rows], "id long, s array<long>")
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, label long")
    made, plain = [], minhash.group_apart

    def counted(df, keys, *aggregates):
        if keys == ["token"]:
            made.append({r.label for r in df.select("label").distinct().collect()})
        return plain(df, keys, *aggregates)

    monkeypatch.setattr(minhash, "group_apart", counted)
    assert [tuple(r) for r in minhash._by_rare_shingles(nodes, sets, 80).collect()] == [(3, 4)]
    assert made == [{3, 4}]


def test_bits_of_all_places_are_found(spark):
    keys = spark.range(0, 70_000, 7)
    found = maybe_member(spark.range(70_000), F.col("id"), bit_table(keys, F.col("id")), "hit")
    assert found.where("hit != (id % 7 = 0)").count() == 0
