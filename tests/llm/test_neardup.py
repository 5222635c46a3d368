"""Near-duplicate classes against all pairs by brute force."""

import collections
import os
import sys

import numpy as np

from weft.llm import neardup

sys.path.insert(0, os.path.dirname(__file__))
from conftest import prose  # noqa: E402


def shingled(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def classes_by_pairs(rows):
    bags = [(d, shingled(t)) for d, t in rows if t and t.split()]
    root = list(range(len(bags)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(bags)):
        for j in range(i):
            a, b = bags[i][1], bags[j][1]
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                root[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for k, (d, _) in enumerate(bags):
        groups[top(k)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def variants():
    rows, k = [], 0
    for base in range(12):
        words = prose(base + 50, 150).split(" ")
        for v in range(8):
            own = list(words)
            for c in range(v * 2):
                own[(c * 37 + v * 11) % len(own)] = f"new{base}{v}{c}"
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(k, rows[3][1]), (k + 1, rows[3][1]), (k + 2, "a b c"), (k + 3, "a b c"), (k + 4, "a b d"), (k + 5, "x " * 500), (k + 6, "x " * 450), (k + 7, "x " * 300)]
    return rows


def test_classes_match_brute_force(spark):
    rows = variants()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_pairs(rows)


def test_blocks_alone_find_every_link(spark, monkeypatch):
    """Without star links, and with tiny blocks, the compared blocks still give the same classes."""
    monkeypatch.setattr(neardup, "STARS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = variants()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_by_pairs(rows)


def test_one_of_each_class_stays(spark):
    rows = variants() + [(900, None), (901, " "), (5, variants()[5][1])]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string")
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = classes_by_pairs(rows)
    assert sorted(ids) == sorted([*set(want.values()), 900, 901])


def test_signatures_estimate_similarity():
    doc, gram, weight = [], [], []
    for d, shift in enumerate((0, 100)):  # weights 1..4, overlap 0.8 of 1000
        for g in range(1000):
            doc.append(d)
            gram.append(g + shift)
            weight.append(1 + (g + shift) % 4)
    a, b = neardup.signatures(np.array(doc), np.array(gram, dtype=np.uint64), np.array(weight), 2)
    bags = [{g: w for d, g, w in zip(doc, gram, weight, strict=True) if d == k} for k in (0, 1)]
    keys = set(bags[0]) | set(bags[1])
    truth = sum(min(bags[0].get(k, 0), bags[1].get(k, 0)) for k in keys) / sum(max(bags[0].get(k, 0), bags[1].get(k, 0)) for k in keys)
    assert abs((a == b).mean() - truth) < 0.1


def test_hot_keys_give_the_same_classes(spark, monkeypatch):
    """With every key above one row counted as hot, and with two of them at most."""
    from weft.llm import common

    rng = np.random.default_rng(11)
    base = [[f"w{x}" for x in rng.integers(0, 500, 60)] for _ in range(6)]
    rows = []
    for k in range(150):
        own = list(base[k % 3 if k < 120 else k % 6])
        if k % 4:
            own[int(rng.integers(0, 60))] = f"z{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, neardup.near_duplicates(df).collect()))
    for keys in (1024, 2):
        monkeypatch.setattr(common, "HOT_ROWS", 1)
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == plain


def test_rows_that_differ_in_other_columns_only(spark):
    """The row kept does not depend on the order or the partitions."""
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, f"s{k}", k) for k in range(20)] + [(2, text + " more", "s", 1)], "doc_id long, text string, source string, n_chars long")
    kept = [[tuple(r) for r in neardup.drop_near_duplicates(d).collect()] for d in (df, df.repartition(5), df.orderBy("n_chars", ascending=False).coalesce(1))]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def test_saved_tables_can_be_dropped(spark):
    import os

    from weft.llm import common

    saved = common.save(spark.range(5), "small")
    path = saved._weft_path.removeprefix("file://").removeprefix("file:")
    assert saved.count() == 5 and os.path.isdir(path)
    common.drop(saved)
    common.drop(saved)
    assert not os.path.exists(path)
