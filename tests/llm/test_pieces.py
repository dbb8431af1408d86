"""Against the library that the model file is made for."""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from arbitra.llm import pieces
from arbitra.llm.pieces import PieceCoder, encode_and_decode
from arbitra.llm.queries import op13_piece_round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
CODER = PieceCoder(PATH)


def holds(texts):
    want = LIBRARY.encode(texts, add_bos=True, add_eos=True)
    got = CODER.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [CODER.decode(x) for x in got] == [LIBRARY.decode(x) for x in want]


def test_hard_texts():
    holds(["", " ", "  ", "a", "  a  b ", "\n", "\n\n a", "▁a ▁▁b", "<s>x</s><unk>", "<0x41>", "한국어 텍스트 😀👍🏽", "a\x00b\x1cc\x85d", "x" * 5000, "ab" * 500, "thethe" * 50, "the" * 1000])
    holds(["\t\tif x:\n\t    return 1\n", "ﬃ①½", "\ufffd", "  \n  \n", "é é ñ", "ḍ̇ " * 9, "𝕏" * 30])


@pytest.mark.parametrize("scanned", [8, 1 << 14])
def test_repeated_and_overlapping_pairs(monkeypatch, scanned):
    monkeypatch.setattr(pieces, "SCANNED", scanned)
    r, letters = random.Random(scanned), "abcdefghinorst "
    holds(["".join(r.choice(letters[: r.randint(2, 15)]) for _ in range(r.randint(1, 90))) for _ in range(3000)])
    whole = list(CODER.model.ids)
    holds(["".join(r.choice(whole) for _ in range(r.randint(1, 12))).replace("▁", r.choice([" ", "▁", ""])) for _ in range(3000)])


def test_long_word():
    holds([base64.b64encode(random.Random(2).randbytes(60_000)).decode(), "ab" * 30_000])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    holds([text])


def test_any_ids():
    r = random.Random(9)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(0, 31999)]) for _ in range(r.randint(0, 8))]
        assert CODER.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids), ids


def test_unknown_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as layout

    model = layout.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        PieceCoder(str(tmp_path / "m.model"))


def test_odd_rows(odd, none):
    got = sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in encode_and_decode(odd).collect())
    ids = [(r["doc_id"], LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)) for r in odd.collect()]
    assert got == sorted((k, i, LIBRARY.decode(i)) for k, i in ids)
    assert encode_and_decode(none).count() == 0


def test_query(spark):
    from hashlib import sha256

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = []
    for d in docs:
        ids = LIBRARY.encode(d["text"] or "", add_bos=True, add_eos=True)
        want.append((d["doc_id"], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, op13_piece_round_trip(spark, "/root/testdata/sf0.001").collect())) == sorted(want)
