"""Byte-level BPE by way of sentencepiece.

A sentencepiece BPE model is serialised directly from a vocabulary of byte strings and ranks; nothing is
trained. Each byte is mapped to one character, each piece is scored by its negative rank, so that the merge
of highest score is that of lowest rank; normalisation is the identity. Texts are cut into pre-tokens by the
tokenizer's pattern, and each is encoded by itself. Decoding maps ids back to their bytes.

Texts are cut in two steps. A single space with non-space on both sides always starts a pre-token in the
patterns supported here, so the text is split there first, and the ids of the resulting chunks are kept in a
bounded table per worker; only chunks that are new go through the pattern and the model. Encoding is per
row: nothing is shuffled, and the model (about a megabyte) is broadcast.

Defined results: a null text is the empty one (no ids); a text of any length is encoded whole, in one row; equal
texts have equal ids, in repeated rows too; null ids are carried; an empty table gives an empty table. Columns in
``carry`` may have any name and type; one named like a column of the result is replaced by it. Others are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelsift.llm._text import settled

#: Chunks whose ids a worker remembers; beyond it the table starts anew.
REMEMBERED = 300_000
#: Longer chunks are encoded each time, not remembered.
LONG_CHUNK = 64

#: Rows that are encoded before they are sent on.
AT_ONCE = 512

_SPLIT = re.compile(r" (?<=\S )(?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_chars() -> list[str]:
    """One printable character for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(0x100 + extra)
            extra += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: ids are ranks, and the unknown piece comes last."""
    import struct

    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    chars = byte_chars()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(chars[b] for b in token).encode()
        # SentencePiece: piece = 1, score = 2 (float), type = 3
        out += _field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + b"\x18\x01")
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")
    # TrainerSpec: model_type = 3 (BPE is 2), vocab_size = 4, unk_id = 40, bos/eos/pad = 41-43 (none: -1)
    none = _varint((1 << 64) - 1)
    trainer = b"\x18\x02" + b"\x20" + _varint(len(ranks) + 1) + _varint(40 << 3) + _varint(len(ranks)) + b"".join(_varint(n << 3) + none for n in (41, 42, 43))
    # NormalizerSpec: name = 1, add_dummy_prefix = 3, remove_extra_whitespaces = 4, escape_whitespaces = 5
    normalizer = _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder for one vocabulary; made from :func:`model_proto` and the pattern of its pre-tokens."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self._cut = regex.compile(pattern).findall
        chars = byte_chars()
        self._table = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        size = self._sp.get_piece_size() - 1
        self.tokens = [bytes(back[c] for c in self._sp.id_to_piece(i)) for i in range(size)]
        self._ranks = {t: i for i, t in enumerate(self.tokens)}
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = array("I")
        for piece in self._cut(text):
            raw = piece.encode()
            whole = self._ranks.get(raw)
            if whole is not None:
                ids.append(whole)
            else:
                ids.extend(self._sp.encode(raw.decode("latin-1").translate(self._table)))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order."""
        chunks = _SPLIT.split(text)
        later, out = self._later, []
        head = chunks[0]
        known = self._first.get(head)
        if known is None:
            known = self._encode(head)
            if len(head) <= LONG_CHUNK:
                if len(self._first) >= REMEMBERED:
                    self._first.clear()
                self._first[head] = known
        out.append(known)
        for chunk in chunks[1:]:
            known = later.get(chunk)
            if known is None:
                known = self._encode(" " + chunk)
                if len(chunk) <= LONG_CHUNK:
                    if len(later) >= REMEMBERED:
                        later.clear()
                    later[chunk] = known
            out.append(known)
        return b"".join(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, carry: list[str] | None = None, with_decoded: bool = True) -> DataFrame:
    """One row per document: id (or the columns in ``carry``), n_tokens, ids_sha256, decoded_sha256 and, if
    wanted, token_ids (array) and decoded (binary)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model_proto(read_ranks(vocabulary)))
    made: dict = {}

    def run(batches):
        coder = made.get("coder")
        if coder is None:
            coder = made["coder"] = ByteBPE(model.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                out: dict = {k: [] for k in made_names}
                for text in part.column(1):
                    ids = array("I", coder.encode(text.as_py() or ""))
                    decoded = coder.decode(ids)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(_little(ids)).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        out["token_ids"].append(np.frombuffer(ids, np.uint32).astype(np.int32))
                    if with_ids and with_decoded:
                        out["decoded"].append(decoded)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, kinds[k]) for k, v in out.items()]], names=["row", *made_names])

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "token_ids": pa.list_(pa.int32()), "decoded": pa.binary()}
    made_names = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids, *["decoded"] * (with_ids and with_decoded)]
    carried = [c for c in ([id_col] if carry is None else carry) if c not in made_names]
    # the carried columns travel as one struct, so their names can't meet others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    made_fields = [T.StructField(n, t) for n, t in zip(made_names, (T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType()), T.BinaryType()))]
    encoded = rows.mapInArrow(settled(run), T.StructType([rows.schema[0], *made_fields]))
    return encoded.select(*[F.col("row").getField(c).alias(c) for c in carried], *made_names)


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()
