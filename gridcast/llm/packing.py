"""Concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises every document, appends the end id and keeps its ids with the tokens before it in its partition.
The partition totals (one row each) become global offsets by a prefix sum. Pass two cuts the one global stream at
multiples of the window: a document that crosses a cut yields one piece, a boundary record, on each side.

Tokens come from a public tokenizer whose pieces never hold white space, so a text is split at spaces and line feeds
and the ids of each chunk are looked up in a bounded per-worker table; chunks not yet seen go through the tokenizer.

Cases: null text is empty and gives the end id alone; ids may be null or repeat; an empty table gives no rows; only
the last window is short; other columns aren't carried.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, write_table

#: Chunks remembered by a worker, and the longest that is: about 80 MB at most.
KEEP_CHUNKS, KEEP_LENGTH = 350_000, 40
#: The longest of those that stay when there are too many and after a task, and how many do at most.
KEEP_SHORT, KEEP_AFTER = 7, 150_000
#: A stop or comma that isn't after a letter, digit or space of Latin-1, and so may share a token with a symbol.
BOUND_STOP = re.compile(r"[^\s0-9A-Za-zÀ-ÖØ-öø-ÿ][.,]|[.,][^\s0-9A-Za-zÀ-ÖØ-öø-ÿ]")
#: Chunks joined into one text for the tokenizer, and the special token between those that aren't plain words.
AT_ONCE, SPECIAL = 500, "<|startoftext|>"
#: Documents tokenised together.
AT_A_TIME = 1000
#: Plain words: small letters of Latin-1.
WORD = re.compile("[a-zß-öø-ÿ]+")


class ChunkTokenizer:
    """ids (little-endian unsigned 32 bits) of texts, as the tokenizer gives for each whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = self.tokenizer.token_to_id(SPECIAL)
        # for words of small Latin-1 letters normalising changes nothing and splitting gives the word: only the merges act
        bare = json.loads(Path(path).read_text(encoding="utf-8"))
        split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split]}}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        suffix, vocabulary = bare["model"]["end_of_word_suffix"], self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.seen: dict[str, bytes] = {"": b""}

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """ids of chunks: many in one text, cut again after ends of words or at the special token."""
        words, others, odd = [], [], []
        for c in chunks:
            if WORD.fullmatch(c):
                words.append(c)
            elif "<|" in c or len(c) > KEEP_LENGTH:
                odd.append(c)
            else:
                others.append(c)
        for group in (words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE)):
            ids = self._ids(self.merges, [" ".join(group)])[0]
            data, at = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            yield from zip(group, map(data.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True)
        for group in (others[i : i + AT_ONCE] for i in range(0, len(others), AT_ONCE)):
            ids = self._ids(self.tokenizer, [SPECIAL.join(group)])[0]
            data, at = ids.tobytes(), np.flatnonzero(ids == self.special)
            yield from zip(group, map(data.__getitem__, map(slice, [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(data)])), strict=True)
        yield from zip(odd, (x.tobytes() for x in self._ids(self.tokenizer, odd)), strict=True)

    @staticmethod
    def spaced(text: str) -> str:
        """The text with spaces only where no token stands. The tokenizer lower-cases, and for Latin-1 lower() is the same."""
        if text.isascii() or _latin(text):
            if "<|" not in text:
                text = text.lower()
            text = text.replace("\n", " ")
            if BOUND_STOP.search(text) is None:
                text = text.replace(", ", " , ").replace(". ", " . ")
            return text
        return text.replace("\n", " ")

    def trim(self) -> None:
        """Keep the short chunks only, as they come again most."""
        kept = {c: ids for c, ids in self.seen.items() if len(c) <= KEEP_SHORT}
        self.seen = kept if len(kept) <= KEEP_AFTER else {"": b""}

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and how many each has."""
        if len(self.seen) > KEEP_CHUNKS:
            self.trim()
        seen = self.seen
        split = pc.split_pattern(pa.array([self.spaced(t) for t in texts], pa.large_string()), " ")
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [c for c in distinct if c not in seen]
        seen.update(self._fresh(new))
        parts = list(map(seen.__getitem__, distinct))
        for c in new:
            if len(c) > KEEP_LENGTH:
                del seen[c]
        index = chunks.indices.to_numpy()
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        first = (np.cumsum(sizes) - sizes)[index]
        count = sizes[index]
        ends = np.cumsum(count)
        ids = np.frombuffer(b"".join(parts), dtype="<u4")[np.repeat(first - (ends - count), count) + np.arange(count.sum())]
        at = np.append(0, ends)[split.offsets.to_numpy()]
        return ids, np.diff(at)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, tokens = self.encode_all(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(tokens)[:-1])] if texts else []


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_tokenizers: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer; a worker keeps it for its later tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at = chunk_tokenizer(path), 0
        for batch in (b.slice(i, AT_A_TIME) for b in batches for i in range(0, b.num_rows, AT_A_TIME)):
            ids, tokens = tokenizer.encode_all([t or "" for t in batch.column("text").to_pylist()])
            tokens += 1
            ends = np.cumsum(tokens)
            closed = np.full(len(ids) + len(tokens), end_id, dtype="<u4")
            inner = np.ones(len(closed), dtype=bool)
            inner[ends - 1] = False
            closed[inner] = ids
            offsets = pa.py_buffer(np.append(0, ends * 4).astype(np.int64))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tokens), [None, offsets, pa.py_buffer(closed)])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), packed.cast(pa.binary()), pa.array(tokens), pa.array(ends - tokens + at)], ["part", "id", "ids", "tokens", "before"])
            at += int(ends[-1]) if len(ends) else 0
        tokenizer.trim()

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary)."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = write_table(source.mapInArrow(released(_tokenise(tokenizer_path, end_id)), "part int, id long, ids binary, tokens long, before long"), "pack")
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("n"))
    offsets, at = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in totals.collect()):  # one row a partition
        offsets.append((part, at))
        at += n
    offsets = spark.createDataFrame(offsets, "part int, part_before long")
    placed = tokens.join(F.broadcast(offsets), "part")
    placed = placed.select("id", "ids", "tokens", (F.col("part_before") + F.col("before")).alias("first"))
    last = F.expr(f"(first + tokens - 1) div {window}")
    placed = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"first div {window}"), last)))
    start = F.greatest(F.lit(0), F.col("sequence_id") * window - F.col("first"))
    end = F.least(F.col("tokens"), (F.col("sequence_id") + 1) * window - F.col("first"))
    placed = placed.withColumn("start", start).withColumn("length", end - start)
    piece = F.expr("substring(ids, CAST(4 * start + 1 AS INT), CAST(4 * length AS INT))")
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.crc32(piece).alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        (F.col("first") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
        piece.alias("ids"),
    )
