import hashlib
import random
from array import array

import pytest

from pixelsift.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_library(reference):
    coder = byte_bpe.ByteBPE(byte_bpe.model_proto(byte_bpe.read_ranks(PATH)), P.PATTERN)
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \n\t 　\x1c ab1é.'s漢🙂<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in [*odd, "", " ", "x" * 3000, " " * 3000, "<|endoftext|>", "I'll we've don't", "﻿a b"]:
        ids = array("I", coder.encode(text))
        assert ids.tolist() == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_documents(docs, reference):
    texts = [(1, None), (2, ""), (3, "Hello  world\n"), (None, "é 1.5"), (3, "Hello  world\n"), (4, "long " * 50_000)]
    rows = byte_bpe.encode_documents(docs(*texts, extra=("n_tokens", "ids_sha256", "decoded", "token_ids", "_text", "row", "text_")), PATH, P.PATTERN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = bytes(r.decoded).decode()
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, list(r.token_ids)) == (len(ids), ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_documents(docs((1, "x")).limit(0), PATH, P.PATTERN).count() == 0


def test_carried_columns(docs):
    """Columns named like the operator's own are carried, those named like a new column are replaced."""
    df = docs((1, "a b c"), (None, None), extra=("n_tokens", "_text", "row", "decoded_sha256"))
    out = byte_bpe.encode_documents(df, PATH, P.PATTERN, carry=[c for c in df.columns if c != "text"])
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_text", "row", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"]
    assert {(r.doc_id, r.n_tokens, r._text, r.row) for r in out.collect()} == {(1, 3, 7, 7), (None, 0, 7, 7)}
