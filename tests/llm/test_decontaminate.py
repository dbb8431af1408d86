"""Exact and substituted passages, and clean texts."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import LOREM, SCHEMA, prose

from arbitra.llm.decontaminate import MASKS, build_index, contamination, drop_contaminated, overlaps
from arbitra.llm.kernels import WordHasher, alphanumeric

ITEMS = [(1, prose(71, 40)), (2, prose(72, 15)), (3, "Just five plain words here"), (4, "too short"), (5, None), (6, ""), (7, prose(71, 40)), (8, prose(73, 9))]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "") for i, t in enumerate(texts)], SCHEMA)


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def changed(text, every, seed=0):
    w = text.split()
    for i in range(every // 2, len(w), every):
        w[i] = f"changed{seed}"
    return " ".join(w)


def test_exact_and_substituted(spark, bench):
    one = dict(ITEMS)
    df = docs(spark, [
        f"{prose(1, 50)} {one[1].upper()}. {prose(2, 50)}", f"{prose(3, 50)}, {changed(one[1], 7)} {prose(4, 9)}", one[2], f"so {one[3]} again", "too short", one[8], prose(5, 400),
        " ".join(one[1].split()[10:24]), " ".join(one[1].split()[10:20]), changed(one[1], 2), "", None,
    ])
    assert pairs(contamination(df, bench)) == {(0, 1), (0, 7), (1, 1), (1, 7), (2, 2), (3, 3), (4, 4), (5, 8), (7, 1), (7, 7)}
    assert {r["doc_id"] for r in drop_contaminated(df, bench).collect()} == {6, 8, 9, 10, 11}
    row = contamination(df, bench).filter("doc_id = 0 and item_id = 1").first()
    assert (row["equal_tokens"], row["first_token"], row["end_token"]) == (40, 50, 90)


def test_blocks_give_the_same(spark, bench):
    df = docs(spark, [f"{prose(i, 30)} {ITEMS[i % 2][1]}" for i in range(20)])
    assert pairs(contamination(df, bench)) == pairs(contamination(df, bench, block=100))
    assert drop_contaminated(df, bench, block=100).count() == 0


def test_odd(spark, odd, none, bench):
    assert contamination(odd, bench).count() == 0
    kept = drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert contamination(none, bench).count() == 0
    nothing = bench.filter("item_id = 5 or item_id = 6")
    assert contamination(odd, nothing).count() == 0 and contamination(odd, bench.limit(0)).count() == 0


def test_every_placement(spark, bench):
    r = random.Random(6)
    texts = []
    for i in range(60):
        w = prose(200 + i, r.randint(0, 60)).split()
        at = r.randint(0, len(w))
        texts.append(" ".join(w[:at] + changed(ITEMS[0][1], r.randint(9, 14), i).split() + w[at:]))
    assert {d for d, i in pairs(contamination(docs(spark, texts), bench)) if i == 1} == set(range(60))
    assert LOREM


def test_every_substitution():
    """Each placement of one or two changed tokens, and of three in items of 15 to 17."""
    hasher = WordHasher(alphanumeric())
    for n in [*range(5, 21), 30]:
        w = [f"w{n}x{k}" for k in range(n)]
        index = build_index([1], pa.array([" ".join(w)]))
        for changes in (1, 2, 3) if 14 < n < 18 else (1, 2):
            for at in combinations(range(n), changes):
                text = " ".join(["before", *("other" if k in at else x for k, x in enumerate(w)), "after"]).encode()
                found = overlaps(index, *hasher(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
                equal = [k not in at for k in range(n)]
                best = max(sum(equal[s:e]) for s in range(n) for e in range(s + 1, n + 1) if 5 * sum(equal[s:e]) >= 4 * (e - s))
                assert [f[2] for f in found] == ([best] if best >= min(13, -(-4 * n // 5)) else []), (n, at)


@pytest.mark.parametrize("least", sorted(MASKS))
def test_masks_miss_nothing(least):
    """Every way to change as many tokens as an overlap may have leaves one of the masks whole.

    Of overlaps of 13 equal tokens and more, those that hold no shorter one have up to
    31 tokens, and so up to 6 changed ones.
    """
    sizes = [(16, 3), (20, 4), (25, 5), (30, 6)] if least == 16 else [(least, least - -(-4 * least // 5))]
    for n, changes in sizes:
        equal = np.ones((len(list(combinations(range(n), changes))), n), bool)
        for row, at in zip(equal, combinations(range(n), changes), strict=True):
            row[list(at)] = False
        hit = np.zeros(len(equal), bool)
        for mask in MASKS[least]:
            marks = [i for i, c in enumerate(mask) if c == "1"]
            for k in range(n - len(mask) + 1):
                hit |= equal[:, [k + i for i in marks]].all(axis=1)
        assert hit.all()


def test_against_brute_force(spark):
    """Every diagonal of every text and item, token by token."""
    r = random.Random(9)
    items = [(i, " ".join(r.choice(LOREM[:9]) for _ in range(r.choice([1, 3, 5, 7, 10, 13, 15, 16, 18, 24, 40])))) for i in range(40)]
    texts = []
    for i in range(120):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, 1 + len(w) // 4)):
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join([r.choice(LOREM) for _ in range(r.randint(0, 9))] + w + [r.choice(LOREM[:9]) for _ in range(r.randint(0, 9))]) if i % 10 else r.choice(items)[1])

    def best(a, b):
        need, out = min(13, -(-4 * len(b) // 5)), 0
        if len(b) < 5:
            return len(b) if a == b else 0
        for shift in range(-len(b), len(a) + 1):
            equal = [a[k + shift] == t for k, t in enumerate(b) if 0 <= k + shift < len(a)]
            total = [0]
            for e in equal:
                total.append(total[-1] + e)
            for s in range(len(equal)):
                for e in range(s + 1, len(equal) + 1):
                    same = total[e] - total[s]
                    if same > out and same >= need and 5 * same >= 4 * (e - s):
                        out = same
        return out

    want = {(d, i, n) for d, t in enumerate(texts) for i, x in items if (n := best(t.split(), x.split()))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 60
    for block in (200, 1 << 20):
        assert {(x["doc_id"], x["item_id"], x["equal_tokens"]) for x in contamination(docs(spark, texts), bench, block=block).collect()} == want
