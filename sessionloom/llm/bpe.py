"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every byte maps to one printable character, so a token of the rank file becomes
a piece of such characters, at the place of its rank and with the score -rank:
the best-scored merge is the one of lowest rank, and a piece's id is its rank.
The model normalises nothing. Pre-tokens are encoded one by one; decoding maps
ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionloom.llm.common import keyed_text, release_memory, slices

#: Segments whose ids a worker remembers before it starts anew; it forgets them after each partition.
CACHE = 200_000

#: Unicode's White_Space, which \s stands for in rank-file tokenizers.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_characters() -> str:
    """For each byte one character that is neither space nor control: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0
    for b in range(256):
        out.append(chr(b if b in printable else 0x100 + more))
        more += b not in printable
    return "".join(out)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    """A protobuf field: a varint, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (2**64 - 1))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model of type BPE; piece ids are ranks, and one unknown piece follows."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    chars = byte_characters()
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a token: {missing}")
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Codec:
    """Encodes and decodes with a model from `sentencepiece_model`."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import re

        import regex
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._bytes = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self._map = {b: c for b, c in enumerate(byte_characters())}
        # packed ids of tokens that are text by themselves
        self._whole = {t.decode(): r.to_bytes(4, "little") for t, r in ranks.items() if _is_text(t)}
        self._split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", f"[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])").replace(r"\s+", f"[{WHITE_SPACE}]+")).findall
        # where no pre-token can reach across: a run without white space with the space before it, or white space
        self._segments = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+").findall
        self._local = pattern == SUPPORTED
        self._known: dict[str, bytes] = {}

    def _pretokens(self, segment: str) -> list[str]:
        """The matches of the pattern in a segment; letters alone, with or without a space before them, are one."""
        if self._local and (segment.isalpha() or (segment[0] == " " and segment[1:].isalpha())):
            return [segment]
        return self._split(segment)

    def _encode_pretokens(self, tokens: set[str]) -> dict[str, bytes]:
        """Packed ids of each pre-token; those that are no token of the rank file go to the model in one call."""
        ids, hard, pieces = {}, [], []
        whole, chars, space = self._whole, self._map, self._map[0x20]
        for token in tokens:
            rank = whole.get(token)
            if rank is not None:
                ids[token] = rank
                continue
            hard.append(token)
            # bytes of ASCII letters stand for themselves, and only a space can come before them
            plain = token.isascii() and (token.isalpha() or token[1:].isalpha() and token[0] == " ")
            pieces.append(token.replace(" ", space) if plain else token.encode().decode("latin-1").translate(chars))
        for token, found in zip(hard, self._model.encode(pieces, num_threads=1), strict=True):
            ids[token] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        parts = [self._segments(t) if self._local else [t] * bool(t) for t in texts]
        distinct = set().union(*parts)
        new = {s for s in distinct if s not in self._known}
        if len(self._known) + len(new) > CACHE:
            self._known.clear()
            new = distinct
        split = {s: self._pretokens(s) for s in new}
        ids = self._encode_pretokens(set().union(*split.values()))
        known = self._known
        for segment, tokens in split.items():
            known[segment] = ids[tokens[0]] if len(tokens) == 1 else b"".join([ids[t] for t in tokens])
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def forget(self) -> None:
        self._known = {}

    def decode(self, ids: bytes) -> bytes:
        token = self._bytes
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


#: The split pattern for which `Codec` may work segment by segment.
SUPPORTED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _codec(model: bytes, ranks: tuple[tuple[bytes, int], ...], pattern: str) -> Codec:
    return Codec(model, dict(ranks), pattern)


def byte_bpe(df: DataFrame, ranks_path: str, pattern: str = SUPPORTED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    The rank file is read once, on the driver, and sent to the executors (its
    size is the vocabulary's, not the data's). Texts are not shuffled.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes), and ids if
    `with_ids`. A null text counts as an empty one; repeated rows give repeated
    results; an empty table gives an empty result.
    """
    ranks = read_ranks(ranks_path)
    shared = df.sparkSession.sparkContext.broadcast((sentencepiece_model(ranks), tuple(ranks.items())))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value, pattern)
        for batch in slices(batches):
            n, ids_digest, text_digest, ids = [], [], [], []
            for encoded in codec.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                n.append(len(encoded) // 4)
                ids_digest.append(hashlib.sha256(encoded).hexdigest())
                text_digest.append(hashlib.sha256(codec.decode(encoded)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(encoded, dtype="<i4"))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()), "decoded_sha256": pa.array(text_digest, pa.string())}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)
        codec.forget()
        release_memory()

    return keyed_text(df, id_col, text_col).selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)
