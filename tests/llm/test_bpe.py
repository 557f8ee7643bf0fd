import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from streetloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def oracle(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    letters = "etaoinshrdlu éèüßñçÀ" + "0123456789.,!?'\n\t\r \xa0\x1c\x85²½ªſ" + "日本語한국어Ωжя😀 \u3000\u200b\x00"
    yield from ("", " ", "  a  b ", "it's we'll I'M they'd", "\n\n \n x", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "x" * 9000, "ab" * 5000, "é" * 3000)
    for size in (3, 10, 40, 300):
        for _ in range(150):
            yield "".join(rng.choice(letters) for _ in range(size))
    yield "".join(rng.choice("abcdeéü") for _ in range(20000))


def test_ids_match_the_library(ranks, oracle):
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN, max_pieces=500)
    for text in texts():
        assert own.encode(text) == oracle.encode_ordinary(text), text[:80]


@pytest.mark.parametrize("max_pieces", [1, 500, 150_000])
def test_many_texts_match_the_library(ranks, oracle, max_pieces):
    own, given = bpe.Encoder(ranks, public_tokenizers.PATTERN, max_pieces), [None, *texts(), " ".join(f"q{n}ü{n * n}" for n in range(3000))]
    assert list(own.encode_all(given)) == [oracle.encode_ordinary(text or "") for text in given]
    assert len(own._pieces) <= max_pieces
    assert list(own.encode_all([])) == []


def test_short_pieces_of_many_texts_are_run_together(ranks, oracle, monkeypatch):
    rng, one_by_one, stepped = random.Random(11), [], bpe.Transducer.encode
    monkeypatch.setattr(bpe.Transducer, "encode", lambda self, piece: one_by_one.append(piece) or stepped(self, piece))
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    given = [" ".join("".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randrange(1, 40))) for _ in range(200)) for _ in range(30)] + ["z" * 65]
    assert list(own.encode_all(given)) == [oracle.encode_ordinary(text) for text in given]
    assert one_by_one == [b"z" * 65]


def test_crowds_of_pieces_are_run_in_parts(ranks, oracle, monkeypatch):
    monkeypatch.setattr(bpe, "_CROWD", 100)
    own, sizes = bpe.Encoder(ranks, public_tokenizers.PATTERN), []
    run = own._pieces.run_all
    own._pieces.run_all = lambda part: sizes.append(len(part)) or run(part)
    text = " ".join(f"q{chr(97 + n % 26)}x{'éz'[n % 2] * (n % 50)}" for n in range(3000))
    assert list(own.encode_all([text])) == [oracle.encode_ordinary(text)]
    assert len(sizes) > 1 and max(sizes) == 100


def test_arrays_judge_pairs_like_one_by_one(ranks):
    words, rng = bpe.Vocabulary(ranks), random.Random(5)
    made = [r for t, r in ranks.items() if len(t) == 1 or words.halves(r)]
    pairs = [(rng.choice(made), rng.choice(made)) for _ in range(20000)]
    pairs += [(ranks[t[:i]], ranks[t[i:]]) for t in rng.sample(sorted(ranks), 3000) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    together = bpe.Together(words)
    asked = np.array([a << 24 | b for a, b in pairs])
    want = [words.follows(a, b) for a, b in pairs]
    assert 0 < sum(want) < len(want)
    for _ in range(2):  # new pairs, then known ones
        assert together._meet(asked).tolist() == want


def test_a_missing_byte_is_an_error_of_both_ways():
    few = {bytes([b]): b for b in range(97, 123)}
    own = bpe.Encoder(few, public_tokenizers.PATTERN)
    assert list(own.encode_all(["abcxyz"])) == [[97, 98, 99, 120, 121, 122]]
    for bad in ("abCd", "C"):
        with pytest.raises(ValueError, match="lacks byte 67"):
            own.encode(bad)
        with pytest.raises(ValueError, match="lacks byte 67"):
            list(own.encode_all([bad]))


def test_states_can_be_dropped(ranks, oracle):
    own = bpe.Transducer(bpe.Vocabulary(ranks), max_states=20)
    for text in texts():
        piece = text.encode()[:200]
        want = oracle._encode_single_piece(piece) if piece else []
        whole = ranks.get(piece)
        assert ([whole] if whole is not None else own.encode(piece)) == want


def test_stream_decodes_like_one_pass(ranks):
    back, rng = bpe.Decoder(ranks), random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(len(ranks)) for _ in range(rng.randrange(60))]
        whole = back.to_bytes(ids).decode("utf-8", "replace")
        for size in (1, 2, 7):
            assert "".join(back.stream(ids, size)) == whole
    utf8, data = bpe.Utf8(), bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xED, 0xF0, 0xF4, 0xFF, 0xA0, 0x9F, 0x90]) for _ in range(5000))
    assert "".join(utf8.feed(data[i : i + 1]) for i in range(len(data))) + utf8.end() == data.decode("utf-8", "replace")


def test_frames(spark, ranks, oracle):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Ünïted states' it's", "x"), (3, "Ünïted states' it's", "x"), (None, "日本 語", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    there = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert there.columns == ["doc_id", "text", "ids"]
    back = bpe.decode(there, PATH).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in back] == [(d, oracle.encode_ordinary(t or ""), t or "") for d, t, _ in rows]
    got = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    for (d, t, _), r in zip(rows, got, strict=True):
        ids = oracle.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
