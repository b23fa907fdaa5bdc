import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from llm.conftest import EDGES, frame, same
from loomwork.llm import piece_codec

MODEL = piece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
PIECES = piece_codec.PieceModel(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def check(texts):
    got = PIECES.encode(pa.array(texts, pa.string()))
    want = [x + [LIBRARY.eos_id()] for x in LIBRARY.encode(["" if t is None else t for t in texts])]
    assert got.to_pylist() == want
    assert PIECES.decode(got).to_pylist() == LIBRARY.decode(want)


def test_ids_and_texts_of_the_library():
    check(["", " ", "  a", "a  b ", "▁a", "\n\nfoo", "a\tb", "</s>x<s>", "日本語𝄞é", "\x00a", "a▁▁b", None, "       " * 9, "▁▁ ▁x " * 9, "a" * 50, "ab" * 30, "<0x0A>", "=" * 40])


def test_random_texts():
    rng = random.Random(1)
    check(["".join(rng.choice("ab  ▁e\nnorst.-=*#é日") for _ in range(rng.randint(0, 60))) for _ in range(4000)])
    check(["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x4E00, 0x9000), 32, 97, 101, 0x1F600])) for _ in range(rng.randint(0, 60))) for _ in range(2000)])


def test_decoding_any_ids():
    rng = random.Random(2)
    ids = [[rng.randrange(32000) for _ in range(30)] for _ in range(1000)] + [[rng.randrange(259) for _ in range(30)] for _ in range(2000)]
    assert PIECES.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == LIBRARY.decode(ids)


def test_lookup_finds_all_and_nothing_else():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    found = piece_codec.Lookup(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    assert (found.find(np.setdiff1d(np.arange(10000), keys)) == -1).all()


def test_edge_rows(spark):
    got = piece_codec.encode_decode(frame(spark, EDGES), MODEL).collect()
    want = [(i, x + [2], LIBRARY.decode(x)) for i, t in EDGES for x in [LIBRARY.encode(t or "")]]
    assert same([(r[0], list(r[1]), r[2]) for r in got], want)
    assert piece_codec.encode_decode(frame(spark, []), MODEL).count() == 0


def test_text_in_parts():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab  ▁e\nnorst.-=*#é日") for _ in range(6000)), "".join(rng.choice("abcdefgh") for _ in range(5000)), "日本語の文" * 900,
            " " * 3000 + "x" + "▁" * 3000, "=" * 4000, "word " * 1500, "\U0001F600" * 1200, ""]
    for text in made:
        data = text.encode()
        parts = list(PIECES.encode_long(data, 300))
        assert [i for p in parts for i in p.tolist()] == LIBRARY.encode(text)
        assert PIECES.decode_long(parts).decode() == LIBRARY.decode(LIBRARY.encode(text))
    assert len(list(PIECES.encode_long(made[0].encode(), 300))) > 10


def test_cut_behind_a_window_without_places(monkeypatch):
    monkeypatch.setattr(piece_codec, "WINDOW", 16)
    text = ("=" * 200 + "\x00q") * 20 + "日本語 " * 40
    assert [i for p in PIECES.encode_long(text.encode(), 50) for i in p.tolist()] == LIBRARY.encode(text)


def test_text_larger_than_a_slice(spark):
    text = "".join(f"Line {i} of a long text, word{i % 977}!\n" for i in range(120_000))
    assert len(text) > 3 * piece_codec.CODEC_BYTES
    got = piece_codec.encode_decode(frame(spark, [(1, text), (2, "short")]), MODEL).collect()
    want = [(1, LIBRARY.encode(text) + [2], text), (2, LIBRARY.encode("short") + [2], "short")]
    assert same([(r[0], list(r[1]), r[2]) for r in got], want)
