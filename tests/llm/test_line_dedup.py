"""Against brute force over exact shingle sets."""

from __future__ import annotations

import random

import numpy as np
from conftest import LOREM, SCHEMA, prose

from arbitra.llm import line_dedup
from arbitra.llm.line_dedup import band_rows, buckets, dedup_lines, distinct_counts, drop_repeated_lines, part_of, shingle_sets, shingles


def normal(line):
    return " ".join(b.lower().decode() for b in line.encode().split())


def grams(text):
    c = "".join(" " if c in "\t\n\v\f\r" else c.lower() if c < "\x80" else c for c in text)
    return {c[i : i + 8] for i in range(len(c) - 7)}


def brute(rows):
    """Lines that go: per component of equal or similar lines all but the least."""
    lines = {}
    for d, t in rows:
        for p, line in enumerate([] if t is None else t.split("\n")):
            if line.strip(" \t\n\v\f\r"):
                lines[d, p] = line
    firsts = {}
    for k in sorted(lines):
        firsts.setdefault(normal(lines[k]), k)
    keys = list(firsts)
    sets = [grams(lines[firsts[k]]) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    stays = {}
    at = {k: n for n, k in enumerate(keys)}
    for k in sorted(lines):
        stays.setdefault(find(at[normal(lines[k])]), k)
    return {k for k in lines if stays[find(at[normal(lines[k])])] != k}


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    gone = brute(rows)
    out = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    for d, t in rows:
        want = None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (d, p) not in gone)
        assert out[d] == want
    return gone


def test_odd(odd, none):
    df = odd.dropDuplicates(["doc_id"])
    check(df)
    assert dedup_lines(odd).count() == odd.count()
    assert dedup_lines(none).count() == 0
    assert dedup_lines(odd).columns == [*odd.columns, "n_lines", "n_removed", "n_left"]


def test_repeated_rows(spark):
    """Each row is a text of its own, whatever its doc_id: of equal lines one stays."""
    rows = [(1, "one line\nb"), (1, "one line\nb"), (1, "other\none line"), (None, "one line"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines"], r["n_removed"], r["n_left"]) for r in dedup_lines(df).collect())
    assert out == [(0, "one line", 1, 0, 1), (1, "", 2, 2, 0), (1, "b", 2, 1, 1), (1, "other", 2, 1, 1), (2, "", 0, 0, 0)]


def test_shingles_are_characters():
    lines = ["한국어 문장이 하나 있다", "plain ascii line", "mixed é line ascii", "kurz", "plain ascii line too", "ÀÉÎÕÜ" * 3]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    sets = shingle_sets(data, np.append(0, ends[:-1] + 1), ends)
    assert [len(s) for s in sets] == [len(grams(t)) for t in lines]
    for i, x in enumerate(lines):
        assert [len(np.intersect1d(sets[i], s)) for s in sets] == [len(grams(x) & grams(t)) for t in lines]
    alone = np.frombuffer(lines[1].encode(), np.uint8)
    assert shingle_sets(alone, np.array([0]), np.array([len(alone)]))[0].tolist() == sets[1].tolist()


def test_buckets_estimate_similarity():
    """Lines share a band as often as their similarity says, and as they do alone."""
    r = random.Random(3)
    lines = []
    for i in range(400):
        w = prose(20_000 + i, 30).split()
        lines.append(" ".join(w))
        w[r.randrange(30)] = "otherwise é"
        lines.append(" ".join(w))
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    bucket, size = buckets(data, np.append(0, ends[:-1] + 1), ends)
    assert size.tolist() == [len(t) - 7 for t in lines]
    one = np.frombuffer(lines[5].encode(), np.uint8)
    assert buckets(one, np.array([0]), np.array([len(one)]))[0][0].tolist() == bucket[5].tolist()
    like = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in zip(lines[::2], lines[1::2], strict=True)]
    shared = (bucket[::2] == bucket[1::2]).any(axis=1)
    assert min(like) > 0.75 and shared.mean() > 0.99
    assert (bucket[::2] == np.roll(bucket[1::2], 1, axis=0)).any(axis=1).mean() < 0.01


def at_75(r, size):
    """A random line of that many shingles, and its beginning that has three quarters of them."""
    line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(size + 7))
    return line, line[: -(-3 * size // 4) + 7]


def test_recall_by_length():
    """Of pairs at 0.75 or a little above, whatever their length, nearly all share a band."""
    r = random.Random(12)
    for size in (4, 8, 12, 16, 20, 32, 48, 63, 64, 70, 84, 86, 100, 200):
        lines = [x for _ in range(1200) for x in at_75(r, size)]
        data = np.frombuffer("\n".join(lines).encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        found = np.zeros(len(lines) // 2, bool)
        for kind, (at, bucket) in enumerate(band_rows(data, np.append(0, ends[:-1] + 1), ends)):
            whole = np.arange(len(lines) * bucket.shape[1]).reshape(len(lines), -1) + (kind << 40)
            whole[at] = bucket
            found |= (whole[::2] == whole[1::2]).any(axis=1)
        assert found.mean() >= (0.998 if size <= 64 else 0.99), size


def test_short_lines(spark):
    r = random.Random(13)
    pairs = [at_75(r, 8) for _ in range(400)] + [at_75(r, 4) for _ in range(100)]
    equal = [("aaaaaaaaa", "aaaaaaaa"), ("ababababa", "babababab"), ("z" * 5000, "z" * 12), ("xy" * 300, "yx" * 9)]
    rows = [(i, a) for i, pair in enumerate(pairs + equal) for a in pair]
    df = spark.createDataFrame([(k, line) for k, (_, line) in enumerate(rows)], "doc_id long, text string")
    gone = {x["doc_id"] for x in dedup_lines(df).filter("n_removed > 0").collect()}
    assert gone <= set(range(1, len(rows), 2))
    assert len(gone) >= 0.995 * len(rows) / 2 and set(range(2 * len(pairs) + 1, len(rows), 2)) <= gone


def test_distinct_counts():
    lines = ["", "short", "abcdefgh", "ab" * 100, "a" * 9, "".join(chr(97 + i % 26) + str(i) for i in range(300)), prose(3, 30), prose(4, 12), ("".join(map(str, range(30))) + " ") * 40]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    got = distinct_counts(*shingles(data, np.append(0, ends[:-1] + 1), ends)).tolist()
    for line, n in zip(lines, got, strict=True):
        want = len(grams(line))
        assert n == want if want < 86 else n >= 86


def test_dense_buckets(spark, monkeypatch):
    """Thousands of lines that resemble each other by half, and pairs of them at 0.75 to 0.85: all pairs that share a band are found."""
    monkeypatch.setattr(line_dedup, "SMALL", 4)
    r = random.Random(6)
    form = prose(77, 14)
    rows = []
    for i in range(1500):
        own = prose(10_000 + (i - i % 2 if i < 300 else i), 14).split()
        if i < 300 and i % 2:
            own[r.randrange(14)] = "another"
        rows.append((i, form + " " + " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [grams(t) for _, t in rows]
    like = [i for i in range(0, 300, 2) if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])]
    assert len(like) > 100
    gone = {x["doc_id"] for x in dedup_lines(df).filter("n_removed > 0").collect()}
    missed = [i for i in like if i + 1 not in gone]
    # of the pairs that are like, those without a common band may be missed, and no others
    for i in missed:
        a, b = (buckets(d := np.frombuffer(rows[k][1].encode(), np.uint8), np.array([0]), np.array([len(d)]))[0] for k in (i, i + 1))
        assert not (a == b).any()
    assert len(missed) <= 0.02 * len(like)


def test_fuzzy_lines(spark):
    r = random.Random(2)
    pool = [prose(900 + i, r.randint(4, 40)) for i in range(30)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(pool).split()
            if r.random() < 0.5:
                words[r.randrange(len(words))] = r.choice(LOREM)
            lines.append(r.choice([" ", "  "]).join(words) if r.random() < 0.9 else "short")
        docs.append((d, "\n".join(lines), "en", "s", 0))
    df = spark.createDataFrame(docs, SCHEMA.rpartition(",")[0])
    assert len(check(df)) > 60


def test_stage(spark):
    same = prose(31, 60)
    rows = [
        (1, same + "\nmine alone", "en", "s", 1), (2, same, "en", "s", 1), (3, same + "\nbit", "en", "s", 1), (4, "", "en", "s", 0), (5, None, "en", "s", None),
        (6, "own\n" + prose(32, 20), "en", "s", 5), (7, same + "\n \n", "en", "s", 5), (8, "bit\n" + same, "en", "s", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, packed string, n_left long")
    out = {r["doc_id"]: r for r in drop_repeated_lines(df).collect()}
    # 2, 7 and 8 hold nothing of their own
    assert sorted(out) == [1, 3, 4, 5, 6]
    assert out[1]["text"] == rows[0][1] and out[1]["n_left"] == 1 and out[3]["text"] == "bit" and out[5]["text"] is None
    counted = df.withColumnRenamed("n_left", "n_chars")
    assert {r["doc_id"]: r["n_chars"] for r in drop_repeated_lines(counted).collect()} == {1: 1, 3: 3, 4: 0, 5: None, 6: 5}


def test_parts_follow_the_order():
    r = np.random.default_rng(5)
    first, node = r.integers(0, 4, 500), r.permutation(500)
    order = np.lexsort((node, first))
    first, node = first[order], node[order]
    at = [50, 60, 200, 201, 480]
    part = part_of((first[at], node[at]), first, node)
    assert part.tolist() == [sum(i >= b for b in at) for i in range(500)]
