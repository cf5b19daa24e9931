"""Byte-level BPE encoding and decoding through a global distinct-word shuffle (see worddict).

The pre-tokens of every text are exploded with their positions; each distinct pre-token of the corpus is encoded once by
the ranks of a public vocabulary; the ids join back and are put together by position. Decoding joins the ids with the
table token -> bytes, which has as many rows as the vocabulary, whatever the input.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import steady
from .worddict import Answers, answer_words, by_text, texts_from_blocks, to_blocks

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str):
    import regex

    find = regex.compile(pattern).findall
    return lambda text: find(text or "")


def encoder(path: str, pattern: str):
    """Function from distinct pre-tokens to their ids, as little-endian unsigned 32-bit integers."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
    piece = own._encode_single_piece
    return lambda words: [np.array(piece(w), "<u4").tobytes() for w in words]


def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes of the decoded ids) for every row of docs.

    A null text counts as empty: no tokens. Equal rows each have a row, an empty table gives none, other columns are
    dropped. With digest, ids and decoded are their SHA-256 in lowercase hex instead (ids_sha256, decoded_sha256).
    """
    import public_tokenizers

    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    kind = pa.string() if digest else pa.binary()

    def make():
        tokens = token_bytes(path)
        out = (lambda x: hashlib.sha256(x).hexdigest()) if digest else bytes

        def prepare(found: Answers):
            gather = found.gatherer("<u4")

            def texts(doc_ids: list, lengths: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
                ids, per_word = gather(words)
                counts = by_text(lengths, per_word)
                ends = np.cumsum(counts)
                spans = list(zip((ends - counts).tolist(), ends.tolist(), strict=True))
                encoded = [out(ids[a:b].tobytes()) for a, b in spans]
                decoded = [out(decode(ids[a:b], tokens)) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded, kind), pa.array(decoded, kind)], ["doc_id", "n_tokens", *names])

            return texts

        return prepare

    answered = answer_words(to_blocks(steady(docs, "doc_id", "text"), lambda: splitter(pattern)), lambda: encoder(path, pattern))
    return texts_from_blocks(answered, make, f"doc_id long, n_tokens long, {names[0]} {'string' if digest else 'binary'}, {names[1]} {'string' if digest else 'binary'}")
