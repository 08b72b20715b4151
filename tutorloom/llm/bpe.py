"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

``encode`` adds ``token_ids`` (array<int>), ``n_tokens`` and ``n_split`` (tokens that begin inside a character) and, on
request, ``token_spans`` (array<struct<start, end>> in code points; a token that holds part of a character spans that whole
character). ``decode`` turns ``token_ids`` into ``decoded`` (binary) and, on request, ``decoded_text``.

Defined results: a null text is the empty text, which has no tokens; a text of any length is encoded whole; repeated rows
are encoded each; input columns named like an output column are replaced; ids outside the vocabulary raise.
``decoded_text`` replaces bytes that are no UTF-8 (a character cut apart at the end of a list) by U+FFFD, ``decoded`` never does.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tutorloom.llm.common import hand_back, slices

SLICE_CHARS = 1_000_000  # characters of text that are encoded at once
CACHE_PIECES = 400_000  # pieces whose ids a worker remembers; a full cache is emptied


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, all others for the characters from U+0100 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> bytes:
    """The rank file as it is; the driver ships its content, so executors need no such file."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Rank file and pattern as a ``tokenizers`` model, with the tables for both directions."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.token_bytes = np.array(self.bytes_of, dtype=object)
        self.length = np.array([len(t) for t in self.bytes_of], np.int64)
        self.pattern = pattern
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        """The model; a worker that only decodes needs none."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer, models, pre_tokenizers

        char_of = byte_characters()

        def spell(token: bytes) -> str:
            return "".join(char_of[b] for b in token)

        merges = [tuple(map(spell, self.halves(t))) for t in self.bytes_of if len(t) > 1]
        model = models.BPE({spell(t): r for t, r in self.ranks.items()}, merges, ignore_merges=True)
        tokenizer = Tokenizer(model)
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return tokenizer

    @functools.cached_property
    def pieces(self):
        import regex

        return regex.compile(self.pattern).findall

    @functools.cached_property
    def safe_cut(self):
        import regex

        return regex.compile(r"(?<=[^\s]) (?=[^\s])")

    def halves(self, token: bytes) -> list[bytes]:
        """The two parts whose merge makes ``token``: what merging by rank leaves before the last step."""
        parts = [token[i : i + 1] for i in range(len(token))]
        last = len(self.ranks)
        while len(parts) > 2:
            i = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], last))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stretches(self, text: str) -> Iterator[str]:
        """A very long text in parts, cut only before a lone space between two visible characters.

        A match always begins there, because a space that is followed by a visible character opens the next match.
        """
        start = 0
        while len(text) - start > SLICE_CHARS:
            cut = self.safe_cut.search(text, start + SLICE_CHARS)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for stretch in self.stretches(text):
            pieces = self.pieces(stretch)
            new = [p for p in dict.fromkeys(pieces) if p not in self.known]
            if len(self.known) + len(new) > CACHE_PIECES:
                self.known.clear()
                new = list(dict.fromkeys(pieces))
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, np.int32).tobytes()  # numbers as objects would take several times as much
            parts.append(np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token_bytes[ids].tolist())


@functools.lru_cache(maxsize=4)
def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def spans(lengths: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """First and last-plus-one code point of each token, from the tokens' byte lengths and the text's bytes; and how many begin inside a character."""
    opens = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(opens)])  # characters begun before each byte
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inside = ~opens[starts]
    return chars[starts] - inside, chars[ends], int(inside.sum())


def _with_fields(df: DataFrame, drop: set[str], fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    """The columns of ``df`` that stay, and the schema with ``fields`` after them."""
    kept = [c for c in df.columns if c not in drop]
    return kept, T.StructType([*(df.schema[c] for c in kept), *fields])


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", with_spans: bool = False) -> DataFrame:
    """``docs`` with the tokens of column ``text``."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("n_split", T.LongType())]
    fields += [T.StructField("token_spans", T.ArrayType(span, False))] if with_spans else []
    kept, schema = _with_fields(docs, {f.name for f in fields}, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks, pattern)
        for part in slices(batches, text, SLICE_CHARS):
            ids, split, lows, highs = [], [], [], []
            for value in part.column(text).to_pylist():
                value = value or ""
                ids.append(vocab.encode(value))
                low, high, n = spans(vocab.length[ids[-1]], value.encode())
                split.append(n)
                if with_spans:
                    lows.append(low)
                    highs.append(high)
            counts = np.array([len(x) for x in ids], np.int64)
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [part.column(c) for c in kept]
            columns += [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids))), pa.array(counts), pa.array(split, pa.int64())]
            if with_spans:
                each = [pa.array(np.concatenate(x).astype(np.int32)) for x in (lows, highs)]
                columns.append(pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(each, ["start", "end"])))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids", as_text: bool = False) -> DataFrame:
    """``tokens`` with the bytes that column ``ids`` stands for (null ids: empty), and with ``as_text`` the text they spell."""
    fields = [T.StructField("decoded", T.BinaryType())] + ([T.StructField("decoded_text", T.StringType())] if as_text else [])
    kept, schema = _with_fields(tokens, {f.name for f in fields}, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [vocab.decode(x.values.to_numpy()) if x.is_valid else b"" for x in part.column(ids)]
                columns = [part.column(c) for c in kept] + [pa.array(data, pa.binary())]
                columns += [pa.array([d.decode(errors="replace") for d in data], pa.string())] if as_text else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        hand_back()

    return tokens.select(*dict.fromkeys([*kept, ids])).mapInArrow(run, schema)
