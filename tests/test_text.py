"""Digests, splits, redaction and features against plain Python."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from arbitra.functions import text as T

TEXTS = ["", "Hello  World", "Straße  ẞ GROẞ", "한국어 텍스트 😀", 'quote " and \\ back\nline\ttab', "ΣΊΣΥΦΟΣ", "a" * 300, "x"]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def column(df, c):
    return [r["c"] for r in df.select("id", c.alias("c")).orderBy("id").collect()]


def digest(payload):
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_cache_keys(rows):
    assert column(rows, T.state_cache_key(F.lit("m"), "text")) == [digest({"kind": "state", "model_version": "m", "state": " ".join(t.split())}) for t in TEXTS]
    assert column(rows, T.question_cache_key(F.lit("t@1"), "text", F.array(F.lit("a"), F.lit('b"')))) == [
        digest({"kind": "question", "task": "t@1", "question": " ".join(t.split()), "candidates": ["a", 'b"']}) for t in TEXTS
    ]


def test_split(rows):
    def of(group):
        bucket = int(hashlib.sha256(json.dumps(group, ensure_ascii=False).encode()).hexdigest()[:8], 16) % 100
        return "train" if bucket < 80 else "validation" if bucket < 90 else "test"

    assert column(rows, T.split_of("text")) == [of(t) for t in TEXTS]


def test_prompt_folding(rows):
    got = column(rows, T.normalize_prompt("text"))
    assert got == [" ".join(t.casefold().split()) for t in TEXTS]


def test_folding_of_all_characters(spark):
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(map(chr, points[k : k + 500])) for k in range(0, len(points), 500)] + [f"a{chr(c)}B" for c in (0xDF, 0x1E9E, 0x130, 0xFB03, 0x3C2, 0x10400)] + ["", "PLAIN Ascii", "Straße STRASSE"]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id int, text string")
    assert column(df, T.casefold("text")) == [*(t.casefold() for t in texts), None]


def test_redaction(spark):
    texts = ["mail me.x+y@host.example now", "key sk-abcdefghijklmnop end", "Bearer abc.def", "call +82 10-1234-5678.", "no 12345", "ghp_0123456789abcdef"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert column(df, T.redact("text")) == ["mail [EMAIL] now", "key [SECRET] end", "[SECRET]", "call [PHONE].", "no 12345", "[SECRET]"]


def test_features(rows):
    import re

    def fid(token, v, prefix=""):
        return 2 + int(hashlib.sha256((prefix + token).encode()).hexdigest()[:8], 16) % (v - 2)

    def words(t):
        return re.findall(r"\w+", t.casefold())

    def grams(t):
        return [f"^{w}$"[i : i + n] for w in words(t) for n in range(2, 6) for i in range(len(w) + 2 - n + 1)]

    assert column(rows, T.word_features("text", 100, 5)) == [[fid(w, 100) for w in words(t)[:5]] for t in TEXTS]
    assert column(rows, T.char_features("text", 100, 50)) == [[fid(g, 100) for g in grams(t)[:50]] for t in TEXTS]
    assert column(rows, T.byte_features("text", 258, 20)) == [[2 + b % 256 for b in t.encode()[:20]] for t in TEXTS]
    assert column(rows, T.padded(T.word_features("text", 100, 3), 3)) == [([fid(w, 100) for w in words(t)[:3]] + [0] * 3)[:3] for t in TEXTS]


def test_truthy(spark):
    df = spark.createDataFrame([(1, "", None, "c"), (2, "a", "b", None), (3, None, "", None)], "id int, x string, y string, z string")
    assert column(df, T.truthy("x", "y", "z")) == ["c", "a", None]
