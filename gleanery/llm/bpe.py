"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary is a file of ranks. Its merges follow from the ranks, so the tokenizers
library can encode by it: every byte is written as one printable character, the pattern
splits a text into matches, and each match is merged by rank. Token offsets come back
through the byte-to-character mapping, so a token that holds part of a character has
that character's span. Decoding reverses the byte table; bytes are joined before they
are read as UTF-8, so characters split over tokens come out whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanery.llm.common import required, short_batches, without

#: Distinct pieces remembered by a worker; the memory they take is bounded by it.
REMEMBERED = 200_000
#: Longer pieces are not remembered.
SHORT_PIECE = 64

# A space after a character that is not white space always starts a new match, whatever
# follows, so a text may be cut before it and the parts encoded apart. The class leaves
# out everything Unicode calls white space.
_CUT = re.compile(r"(?<=[!-~\u00a1-\u167f\u1681-\u1fff\u2060-\u2fff\u3001-\U0010ffff]) ")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair each token is merged from, in order of rank.

    A token's own bytes, merged with lower ranks only, end as that pair. A token that
    does not end so is reached only as a whole match.
    """
    found = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


class Codec:
    """Encoder and decoder of one rank file. ``path`` must exist on every executor."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        table = byte_characters()
        text = lambda token: "".join(map(table.__getitem__, token))
        self._tokenizer = Tokenizer(
            models.BPE(
                vocab={text(t): r for t, r in ranks.items()},
                merges=[(text(a), text(b)) for a, b in merges_of(ranks)],
                ignore_merges=True,
            )
        )
        self._tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.bytes_of: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self._written = {r: self._tokenizer.id_to_token(r) for r in self.bytes_of}
        # The byte table reversed: which byte a character stands for.
        self._byte = np.zeros(0x200, np.uint8)
        self._byte[[ord(c) for c in table]] = np.arange(256)
        self._lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self._lengths[list(self.bytes_of)] = [len(t) for t in self.bytes_of.values()]
        self._known: dict[str, bytes] = {}

    def encode_batch(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        cut = []
        for text in texts:
            first, *rest = _CUT.split(text)
            cut.append([first, *[f" {part}" for part in rest]])
        known = self._known
        new = list({part for parts in cut for part in parts if part not in known})
        encoded = self._tokenizer.encode_batch_fast(new, add_special_tokens=False)
        known.update((part, np.array(e.ids, "<u4").tobytes()) for part, e in zip(new, encoded))
        found = [np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4") for parts in cut]
        for part in new:
            if len(part) > SHORT_PIECE:
                del known[part]
        return found

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary is an error.

        Tokens are joined as the library writes them, a character for each byte; the reversed
        byte table gives the bytes, those of a character split over tokens one after another.
        """
        written = "".join(map(self._written.__getitem__, ids.tolist()))
        return self._byte[np.frombuffer(written.encode("utf-16-le"), "<u2")].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last character that each token touches."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80)
        ends = np.cumsum(self._lengths[ids])
        return character[ends - self._lengths[ids]] - 1, character[ends - 1]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Add ``ids`` and, with ``offsets``, the ``starts`` and ``ends`` of each token in characters.

    Whole texts are encoded; null gives null lists and the empty text empty ones. Other
    columns are carried, but those of the added names are replaced. Work is per row:
    repeated rows give equal results.
    """
    required(df, text_col)
    short_batches(df.sparkSession)
    added = ["ids", "starts", "ends"] if offsets else ["ids"]
    df = without(df, *added)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in added]])
    column = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(column).to_pylist()
            columns = [own.encode_batch(t or "" for t in texts)]
            if offsets:
                spans = [own.offsets(t or "", i) for t, i in zip(texts, columns[0])]
                columns += [[s for s, _ in spans], [e for _, e in spans]]
            made = [pa.array([None if t is None else v for t, v in zip(texts, c)], pa.list_(pa.int32())) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (the bytes) and ``decoded_text`` (those bytes as UTF-8).

    Incomplete characters at the ends of a cut list of ids read as U+FFFD in the text;
    the bytes are exact. A null list gives nulls, an id outside the vocabulary is an
    error. Columns of the two added names are replaced.
    """
    required(df, ids_col)
    short_batches(df.sparkSession)
    df = without(df, "decoded", "decoded_text")
    added = [T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())]
    schema = T.StructType([*df.schema.fields, *added])
    column = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(column).to_pylist()
            data = [None if ids is None else own.decode_bytes(np.array(ids, np.int64)) for ids in lists]
            texts = [None if b is None else b.decode("utf-8", "replace") for b in data]
            made = [pa.array(data, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode again: (id, n_tokens, ids_sha256, decoded_sha256) per row.

    Null counts as the empty text: no tokens, the digest of no bytes. Other columns are
    ignored, and an empty table gives no rows.
    """
    required(docs, id_col, text_col)
    short_batches(docs.sparkSession)
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            ids = own.encode_batch(t or "" for t in batch.column(1).to_pylist())
            columns = [
                batch.column(0),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([digest(i.tobytes()) for i in ids], pa.string()),
                pa.array([digest(own.decode_bytes(i)) for i in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
