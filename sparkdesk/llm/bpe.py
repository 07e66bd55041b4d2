"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

A text's special strings are cut out, the rest is split into words by the vocabulary's pattern,
and words stand for their bytes. The distinct words of a batch of rows go into a byte trie; a
depth-first walk carries, for every prefix, the last token of the prefix's own encoding. That
token is the only one that ends at the prefix's end and may follow the last token of the
encoding it leaves over, so an encoding is read off by walking back, and a prefix that many
words share is solved once.

Two tokens may follow each other if no merge of lower rank would have joined pieces of both;
the answer is kept per pair. Tokens that their own merges don't produce never occur.

Rows are processed in Arrow batches without a shuffle; what a task remembers between batches
is bounded by ``REMEMBERED`` words and pairs.

Cases: a null or empty text has no ids and decodes to the empty text; ids outside the
vocabulary decode to nothing, and bytes that are no UTF-8 to U+FFFD; repeated rows are encoded
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkdesk.llm.common import read, whole

VOCABULARY = "byte_bpe_50k.json"
# How byte-level vocabularies split a text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words, pieces and pairs that a task keeps; more are solved again when they come back.
REMEMBERED = 300_000
# Last bytes by which tokens are looked up.
ENDING = 3
# Rows of one batch handed to Python, so that a batch of long texts fits in memory.
BATCH_ROWS = 256


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from
    U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts and decodes ids with one vocabulary file."""

    def __init__(self, file: bytes):
        stored = json.loads(file)
        model, to_byte = stored["model"], printable_bytes()

        def raw(token: str) -> bytes:
            return bytes(to_byte[c] for c in token)

        self.split = regex.compile(WORD).findall
        # a blank after white space; before any other blank a word ends, whatever stands there
        self.wide = regex.compile(r"\s ").search
        self.special = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split
        self.id_of = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        texts: dict[int, bytes] = {i: t for t, i in self.id_of.items()}
        texts |= {i: t.encode() for t, i in self.special.items()}
        size = max(texts, default=-1) + 1
        self.packed = [int(i).to_bytes(4, "little") for i in range(size)]
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.all_bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)

        # a token is made by the merge whose halves stay as they are until its rank
        self.rank_of: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.made = [-1 if len(texts.get(i, b"")) == 1 else 1 << 60 for i in range(size)]
        for rank, pair in enumerate(model["merges"]):
            x, y = (self.id_of[raw(t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            whole_token = self.id_of.get(texts[x] + texts[y])
            self.rank_of[x, y] = rank
            if whole_token is not None and self.halves[whole_token] is None and self.stay(x, y, rank):
                self.halves[whole_token], self.made[whole_token] = (x, y), rank
        self.id_of = {t: i for t, i in self.id_of.items() if len(t) == 1 or self.halves[i]}
        self.longest = max(map(len, self.id_of), default=1)
        # lengths of the tokens with the same last ENDING bytes, longest first, then of shorter ones
        found: dict[bytes, set[int]] = {}
        for token in self.id_of:
            found.setdefault(token[-ENDING:], set()).add(len(token))
        for end, sizes in found.items():
            sizes.update(k for k in range(1, len(end)) if end[-k:] in self.id_of)
        self.sizes = {end: tuple(sorted(sizes, reverse=True)) for end, sizes in found.items()}
        self.short = tuple(range(ENDING, 0, -1))
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.opening: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def stay(self, x: int, y: int, until: int = 1 << 60) -> bool:
        """Whether two neighbouring tokens stay apart in all merges of a rank below ``until``.

        Goes back in time: of the two pieces at the border, the one made last is halved. Pieces
        that meet would merge if their rank came before either is used up; among equal ranks
        the merge further left comes first.
        """
        left_ends = right_ends = until
        while True:
            rank = self.rank_of.get((x, y))
            if rank is not None and rank < left_ends and (rank <= right_ends if right_ends < until else rank < until):
                return False
            if self.made[x] < 0 and self.made[y] < 0:
                return True
            if self.made[x] > self.made[y]:
                left_ends, x = self.made[x], self.halves[x][1]
            else:
                right_ends, y = self.made[y], self.halves[y][0]

    def solve(self, fresh: set[str]) -> None:
        """Add the packed ids of words to ``words``.

        In sorted order words are the leaves of their trie, depth first: what the prefix shared
        with the word before has on the path stays, the rest is solved byte by byte.
        """
        # down the path: the last token of every prefix, and how long that token is
        last, length, before = [-1], [0], b""
        id_of, pairs, packed = self.id_of, self.pairs, self.packed
        sizes_of, short, known = self.sizes.get, self.short, self.words
        for path, word in sorted((w.encode(), w) for w in fresh):
            shared = 0
            for x, y in zip(before, path):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], length[shared + 1 :]
            for depth in range(shared + 1, len(path) + 1):
                ending = path[depth - ENDING : depth] if depth > ENDING else path[:depth]
                for size in sizes_of(ending, short):
                    # the prefix's encoding ends with the one token that may follow the rest's
                    if size > depth:
                        continue
                    token = id_of.get(path[depth - size : depth])
                    if token is None:
                        continue
                    if size < depth:
                        key = last[depth - size] << 32 | token
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = self.stay(last[depth - size], token)
                        if not fits:
                            continue
                    last.append(token)
                    length.append(size)
                    break
                else:
                    raise ValueError(f"the vocabulary lacks the byte {path[depth - 1]:#x}")
            ids, end = [], len(path)
            while end:
                ids.append(packed[last[end]])
                end -= length[end]
            known[word] = b"".join(ids[::-1])
            before = path

    def learn(self, opening: set[str], spaced: set[str]) -> None:
        """Know the packed ids of text pieces, those in ``spaced`` with a blank before them."""
        for store, more in ((self.opening, opening), (self.spaced, spaced), (self.words, ()), (self.pairs, ())):
            if len(store) + len(more) > REMEMBERED:
                store.clear()
        pieces = [(self.opening, p, self.split(p)) for p in opening - self.opening.keys()]
        pieces += [(self.spaced, p, self.split(f" {p}")) for p in spaced - self.spaced.keys()]
        self.solve({w for _, _, ws in pieces for w in ws} - self.words.keys())
        words = self.words
        for store, piece, ws in pieces:
            store[piece] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        plain = []  # per text and place: pieces that blanks part, or a special string
        for text in texts:
            cut = self.cut(text) if self.special else [text]
            for i in range(0, len(cut), 2):
                part = cut[i]
                cut[i] = [part] if self.wide(part) else part.split(" ")
            plain.append(cut)
        opening = {p[0] for cut in plain for p in cut[::2]}
        spaced: set[str] = set()
        for cut in plain:
            for p in cut[::2]:
                spaced.update(p[1:])
        self.learn(opening, spaced)
        known_first, known, out = self.opening, self.spaced, []
        for cut in plain:
            parts = []
            for i, p in enumerate(cut):
                if i % 2:
                    parts.append(self.packed[self.special[p]])
                else:
                    parts.append(known_first[p[0]])
                    parts.extend([known[x] for x in p[1:]])
            out.append(b"".join(parts))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids; ids outside the vocabulary are left out."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        places = np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])
        raw = self.all_bytes[places].tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


@lru_cache(maxsize=2)
def encoder(stored: bytes) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(stored)


def _vocabulary(spark: SparkSession, path: str):
    """The file's bytes for every executor; a vocabulary is a few MB, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded: str | None = None,
) -> DataFrame:
    """(id, n_tokens, ids) per document; ids packed as little-endian unsigned 32-bit integers.

    ``decoded`` names a further column for the text that the ids decode to, which saves a
    second pass through Python.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)
    names = ["id", "n_tokens", "ids", *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = enc.encode_batch(part.column(1).to_pylist())
                sizes = pa.array([len(i) // 4 for i in ids], pa.int64())
                columns = [part.column(0), sizes, pa.array(ids, pa.binary())]
                if decoded:
                    texts = [enc.decode(np.frombuffer(i, "<u4")) for i in ids]
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    table = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    kind = table.schema["id"].dataType.simpleString()
    more = f", `{decoded}` string" if decoded else ""
    return table.mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary{more}")


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text of packed ids to a table, in place of a column of that name."""
    vocabulary = _vocabulary(coded.sparkSession, path)
    kept = [c for c in coded.columns if c != text_col]
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [
                    enc.decode(np.frombuffer(ids.as_buffer(), "<u4")) if ids.is_valid else b""
                    for ids in part.column(place)
                ]
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*kept, text_col])

    table = coded.select(*[F.col(f"`{c}`") for c in kept])
    return table.mapInArrow(run, StructType([*table.schema.fields, StructField(text_col, StringType())]))


def op1_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), path)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every document, decode its ids, and digest both."""
    path = path or vocabulary_path()
    both = encode(docs, path, decoded="decoded")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
