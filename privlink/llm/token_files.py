"""Token ids as Parquet: list columns with delta or dictionary encoding, controlled row groups and page indexes.

``write`` deals the documents by id into ranges, sorts each, encodes the texts with the tokenizers library, appends the
end id and writes one file for each range from the worker that holds it: integers as DELTA_BINARY_PACKED (or by
dictionary), row groups of about ``row_group`` bytes of ids, pages of ``page`` bytes, page indexes on.  It returns the
manifest: range, path, documents, ids.  File names carry a random part and only tasks that ended well are in the
manifest, so retried or speculative tasks do no harm.

Metadata (doc_id, offset within the file, length) has columns of its own: ``read`` answers positions without touching a
page of ids, and Spark's own reader, on the same files, prunes row groups and pages by doc_id.  The global start of a
document is its offset plus the ids of the ranges before it; one row for each file enters that sum.

Defined results: a null text counts as empty and has the end id alone; rows with equal ids are ordered by their text;
null ids come first; an empty table gives no file; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, ship, shuffle_partitions

#: A space with white space (or the end) on both sides: only there may a cut in front of a space change a match.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: A word of Latin letters, and a mark behind it: the split pattern of a byte-level tokenizer keeps the one whole, and parts the two.
WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
MARKS = ",.;:!?"
#: The characters that stand for the bytes of a token, as code points of the bytes in Latin-1.
BYTES = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: Distinct pieces, and their characters, that a worker remembers before it starts again; about 200 MB.
REMEMBER, REMEMBER_CHARS = 900_000, 16 << 20
FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32())))])


class Encoder:
    """The library's tokenizer with a memory of pieces.

    Texts are cut in front of spaces, where a match of the split pattern always ends, and each distinct piece is encoded
    once; a text in which such a cut could matter, or with a special token's string, is encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # where a text holds the string of a special token, the library gives that token's id
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocab = self.lib.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # of each id: one character of a token is one byte
        self.bytes_of[list(vocab.values())] = [len(t) for t in vocab]
        self.known: dict[str, bytes] = {}  # a piece without its leading space: the ids of " " + piece
        self.held = 0  # characters in known
        self.marks = {c: self.ids(c) for c in ["", "\n", *MARKS]}
        split, model = self.lib.pre_tokenizer, self.lib.model
        plain = self.lib.normalizer is None and type(split).__name__ == "ByteLevel" and split.use_regex and type(model).__name__ == "BPE" and not model.dropout
        self.model = model if plain else None  # where a word's tokens are the model's own

    def ids(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Words go straight to the model, and marked ones come from them; all others go through the whole tokenizer."""
        if self.model is None:
            self._learn(pieces)
            return
        words, marked, lines, rest = set(), [], [], []
        for w in pieces:
            if WORD.fullmatch(w):
                words.add(w)
            elif (x := self._stem(w)) is not None:
                marked.append((w, x))
            elif w.count("\n") == 1 and None not in (ends := list(map(self._stem, w.split("\n")))):
                lines.append((w, *ends))
            else:
                rest.append(w)
        words.update([x for _, x in marked], [x for _, x, _ in lines])
        known, marks = self.known, self.marks
        new = list(words.difference(known))
        known.update(self._tokens(new, "\u0120"))
        first = self._tokens(list({y for *_, y in lines}), "")  # a word that begins a line has no space in front
        known.update([(w, known[x] + marks[w[len(x) :]]) for w, x in marked])
        for w, x, y in lines:
            at = w.index("\n")
            known[w] = known[x] + marks[w[len(x) : at]] + marks["\n"] + first[y] + marks[w[at + 1 + len(y) :]]
        self.held += sum(map(len, new)) + sum(len(w) for w, *_ in marked + lines)
        if rest:
            self._learn(rest)

    def _stem(self, piece: str) -> str | None:
        """The word of a word with at most one mark behind it."""
        if piece[-1:] in MARKS:
            piece = piece[:-1]
        return piece if WORD.fullmatch(piece) else None

    def _tokens(self, words: list[str], lead: str) -> dict[str, bytes]:
        flat, ends, tokenize = [], [0], self.model.tokenize
        for w in words:
            flat += [t.id for t in tokenize(lead + (w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)))]
            ends.append(4 * len(flat))
        raw = np.array(flat, dtype="<u4").tobytes()
        return dict(zip(words, [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], strict=True))

    def _learn(self, pieces: list[str]) -> None:
        self.held += sum(map(len, pieces))
        for lo in range(0, len(pieces), 1024):  # one call for many pieces; their bytes tell where the ids of each end
            some = pieces[lo : lo + 1024]
            text = " " + " ".join(some)
            if UNSAFE.search(text):  # empty pieces, or white space where two pieces meet
                self.known.update((w, self.ids(" " + w)) for w in some)
                continue
            flat = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            sizes = map(len, some) if text.isascii() else [len(w.encode()) for w in some]
            ends = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(np.fromiter(sizes, np.int64, len(some)) + 1)) + 1
            raw, ends = flat.tobytes(), (4 * ends).tolist()
            self.known.update(zip(some, [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))

    def batch(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBER or self.held > REMEMBER_CHARS:
            self.known.clear()
            self.held = 0
        cuts = [None if UNSAFE.search(t) or self.special.search(t) else t.split(" ") for t in texts]
        new: set[str] = set()
        for parts in cuts:
            if parts:
                new.update(set(parts[1:]).difference(self.known))
        self.learn(list(new))
        get = self.known.__getitem__
        out = []
        for text, parts in zip(texts, cuts, strict=True):
            out.append(self.ids(text) if parts is None else (self.ids(parts[0]) if parts[0] else b"") + b"".join(map(get, parts[1:])))
        return out


encoder = functools.lru_cache(maxsize=2)(Encoder)


def encode_batch(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers."""
    return encoder(path).batch(texts)


def write(
    df: DataFrame,
    tokenizer_path: str,
    out_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_group: int = 16 << 20,
    page: int = 256 << 10,
    dictionary: bool = False,
) -> DataFrame:
    """Encode and write; ids ascend within files and over the ranges (``part``).  Returns the manifest."""
    ship(df.sparkSession)
    placed = (
        df.select(df[id_col].cast("bigint").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        writer, path, part, at, docs, held, size = None, "", 0, 0, 0, [], 0
        packed = None if dictionary else dict.fromkeys(("doc_id", "at", "n_tokens", "ids.list.element"), "DELTA_BINARY_PACKED")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                raw = [x + end for x in encode_batch(tokenizer_path, some.column(1).to_pylist())]
                lens = np.array([len(x) // 4 for x in raw], dtype=np.int64)
                ends = np.cumsum(lens)
                flat = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], type=pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")), type=FILE_SCHEMA.field("ids").type)
                if writer is None:
                    store, root = fs.FileSystem.from_uri(out_path)
                    store.create_dir(root, recursive=True)
                    part = some.column(2)[0].as_py()
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.parquet"
                    path = f"{out_path}/{name}"
                    writer = pq.ParquetWriter(f"{root}/{name}", FILE_SCHEMA, filesystem=store, use_dictionary=dictionary, column_encoding=packed, compression="none", data_page_size=page, write_page_index=True)
                held.append(pa.RecordBatch.from_arrays([some.column(0), pa.array(at + ends - lens), pa.array(lens), flat], schema=FILE_SCHEMA))
                at += int(ends[-1])
                docs += len(raw)
                size += 4 * int(ends[-1])
                if size >= row_group:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    return cut(placed.mapInArrow(run, "part int, path string, n_docs bigint, n_tokens bigint"))


def read(manifest: DataFrame, with_ids: bool = True, with_crc: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens; if asked for, ids, and ids_crc32, the
    unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    spark = manifest.sparkSession
    ship(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))  # one row for each file
    columns = ["doc_id", "at", "n_tokens"] + ["ids"] * (with_ids or with_crc)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as f:
                    for b in pq.ParquetFile(f).iter_batches(batch_size=1024, columns=columns):
                        out = {"doc_id": b.column("doc_id"), "start": pa.array(b.column("at").to_numpy() + base), "n_tokens": b.column("n_tokens")}
                        if with_ids:
                            out["ids"] = b.column("ids")
                        if with_crc:
                            ids, at = b.column("ids").flatten().to_numpy().astype("<u4", copy=False), np.r_[0, np.cumsum(b.column("n_tokens").to_numpy())]
                            out["ids_crc32"] = pa.array([zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)], type=pa.int64())
                        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "doc_id bigint, start bigint, n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_crc32 bigint" * with_crc
    return based.repartition(shuffle_partitions(spark), "path").mapInArrow(run, schema)


def pick(spark: SparkSession, path: str, low: int, high: int, with_ids: bool = True) -> DataFrame:
    """The rows of the documents low..high: row groups and pages of other ids, and without ``with_ids`` all ids, stay unread."""
    rows = spark.read.parquet(path).where(F.col("doc_id").between(low, high))
    return rows if with_ids else rows.drop("ids")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
