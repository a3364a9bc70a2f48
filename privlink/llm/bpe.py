"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode_decode`` is a narrow map: no shuffle, one pass over the texts, one worker-wide tokenizer.  Long texts are
cut at *safe boundaries* so that a single call never sees more than ``LONG`` characters where the text allows it.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; repeated rows and
repeated ids are answered row by row; an empty table gives an empty table; further columns pass through when named in
``keep`` and are ignored otherwise, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

#: Characters of a text that are encoded in one call.
LONG = 100_000
#: Between a letter, number or punctuation mark and a plain space a match of the split pattern always ends: no
#: alternative goes on from a non-space into a space, and its look-ahead only concerns white space in front of it.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?= )|(?<=\p{L})(?=\p{N})")

OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("binary", pa.binary()),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


@functools.lru_cache(maxsize=4)
def tokenizer(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Cut a long text at safe boundaries; encoding the pieces one by one gives the ids of the whole."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text.  A piece far beyond LONG (white space or one word without end) would exhaust the library's matcher:
    it is split by the pattern here, and each match is encoded by itself, as the library does."""
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        if len(piece) <= 2 * LONG:
            ids += enc.encode_ordinary(piece)
        else:
            for m in regex.finditer(enc._pat_str, piece):
                ids += enc._encode_single_piece(m[0])
    return ids


def encode_decode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """Encode each text, decode the ids again, and return ``keep`` with the named ``outputs`` (keys of OUTPUTS).

    Raw-byte decoding: ids give back bytes, never a repaired string.  The ids stay in the worker unless asked for.
    """
    ship(df.sparkSession)
    picked = df.select(*keep, df[text_col].alias("__text"))
    schema = T.StructType([f for f in picked.schema if f.name != "__text"])
    for name in outputs:
        schema.add(name, T._parse_datatype_string(OUTPUTS[name][0]))

    def run(batches):
        enc = tokenizer(ranks_path, pattern)
        for batch in batches:
            made: dict[str, list] = {name: [] for name in outputs}
            for text in batch.column(batch.num_columns - 1):
                ids = encode_text(enc, text.as_py() or "")
                raw = enc.decode_bytes(ids) if "decoded" in made or "decoded_sha256" in made else b""
                for name, out in made.items():
                    if name == "ids":
                        out.append(ids)
                    elif name == "decoded":
                        out.append(raw)
                    elif name == "n_tokens":
                        out.append(len(ids))
                    elif name == "ids_sha256":
                        out.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    else:
                        out.append(hashlib.sha256(raw).hexdigest())
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(v, type=OUTPUTS[k][1]) for k, v in made.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ids back to raw bytes (``decoded``); a null list gives no bytes."""
    ship(df.sparkSession)
    picked = df.select(*keep, df[ids_col].alias("__ids"))
    schema = T.StructType([f for f in picked.schema if f.name != "__ids"]).add("decoded", T.BinaryType())

    def run(batches):
        enc = tokenizer(ranks_path, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids.as_py() or []) for ids in batch.column(batch.num_columns - 1)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(raw, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)
