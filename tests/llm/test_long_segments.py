"""Piece encoding of texts without blanks: blocks give what merging the whole text gives."""

import random
import time

import sentencepiece

from sitebrief.llm import pieces


def test_blocks_equal_the_whole_text():
    vocabulary = pieces.Vocabulary()
    encoder, library = pieces.Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(5)
    for n in range(40):
        letters = ["abc", "ab=", "=", "aé漢😀", "0123456789abcdef", "ABCDEFabcdefghijklmnop0123456789+/"][n % 6]
        size = rnd.choice([pieces.BLOCK - 1, pieces.BLOCK, pieces.BLOCK + 1, 2500, 9000])
        text = "".join(rnd.choice(letters) for _ in range(size))
        if n % 7 == 0:
            text = "=" * size + "x" + "-" * size  # blocks that never agree with their overlap
        if n % 5 == 0:
            text = text[:900] + " " + text[900:] + " " + text
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_no_blanks_is_as_fast_as_prose():
    encoder, rnd = pieces.Encoder(pieces.Vocabulary()), random.Random(1)
    encoder.encode(["a few words"])
    text = "".join(rnd.choice("ABCDEFabcdefghijklmnop0123456789+/") for _ in range(800_000))
    start = time.process_time()
    ids = encoder.encode([text])[0]
    assert time.process_time() - start < 6  # about 2 seconds; the old form took 46
    assert pieces.Decoder(encoder.v).decode(ids.tolist()) == text


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 1 << 18)
    encoder, rnd = pieces.Encoder(pieces.Vocabulary()), random.Random(2)
    for _ in range(30):
        texts = [" ".join(str(rnd.randrange(10**9)) for _ in range(400)) for _ in range(3)]
        encoder.encode(texts)
        assert encoder.held < (1 << 18) + 600_000
