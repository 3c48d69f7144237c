"""Packing documents into fixed windows with bounded space."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.tables import releasing
from bazaarflow.llm.words import chunks
from bazaarflow.session import materialise

WINDOW = 1024
OPEN_WINDOWS = 64
PARTITIONS_PER_MERGE = 16
_MERGED = 1 << 62
_RARE = re.compile("[^\x00-\u024f]")
# Fixed value: how the byte-level tokenizer splits text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


class TokenIds:
    """Token ids as little-endian uint32 bytes, as the tokenizers library gives them.

    With the same vocabulary as a ranks file, texts whose characters are all below U+0250, where
    every Unicode version agrees on letters, digits and white space, take the faster tiktoken
    encoder. Other texts, and those that hold a special token, take the library itself.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = ranks_path and _ranked(ranks_path)

    def encode(self, text: str) -> bytes:
        plain = self.fast and not _RARE.search(text) and not any(s in text for s in self.special)
        ids = self.fast(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def _ranked(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class OpenWindows:
    """A fixed number of open windows; pieces are placed best-fit.

    A piece is (doc_id, start, doc_tokens, ids). Where no window has room and no further one may
    be opened, the piece's head fills up the fullest, which is emitted, and its tail goes on.
    """

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.free: list[int] = []
        self.windows: list[list[tuple]] = []

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        """Place a piece of less than a window; yields the windows that are emitted for it."""
        need = len(piece[3]) >> 2
        fitting = [(f, i) for i, f in enumerate(self.free) if f >= need]
        if fitting:
            room, at = min(fitting)
            self.windows[at].append(piece)
            self.free[at] = room - need
        elif len(self.free) < self.limit:
            self.windows.append([piece])
            self.free.append(self.size - need)
            at = len(self.free) - 1
        else:
            at = min(range(len(self.free)), key=self.free.__getitem__)
            head, tail = _cut(piece, self.free[at])
            self.windows[at].append(head)
            yield self._emit(at)
            yield from self.add(tail)
            return
        if not self.free[at]:
            yield self._emit(at)

    def _emit(self, at: int) -> list[tuple]:
        self.free.pop(at)
        return self.windows.pop(at)


def _cut(piece: tuple, tokens: int) -> tuple[tuple, tuple]:
    doc, start, total, ids = piece
    return (doc, start, total, ids[:4 * tokens]), (doc, start + tokens, total, ids[4 * tokens:])


@lru_cache(2)
def token_ids(path: str, ranks_path: str | None) -> TokenIds:
    return TokenIds(path, ranks_path)


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
    end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
    ranks_path: str | None = None,
) -> DataFrame:
    """All documents in sequences of at most ``window`` tokens, one row per piece.

    A document is its ids followed by ``end_id``. Full windows are cut off first. The rest of each
    document goes to one of the partition's ``open_windows`` windows, best-fit; where none fits, the
    fullest is filled up and emitted. What is open at the end of PARTITIONS_PER_MERGE partitions is
    merged in one small group: its pieces, longest window first, are packed end to end. Only the
    last sequence of each such group has padding. Columns: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and ids (little-endian uint32 bytes; null without ``keep_ids``).
    ``path`` is the tokenizer's file, ``ranks_path`` its vocabulary as ranks, if there is one.

    Null and empty texts are a single ``end_id``. Ids may be null or repeated: each row is packed
    as its own document. Other columns are ignored; an empty table gives no rows.
    """

    def rows(window_pieces: list[tuple], sequence: int, with_ids: bool) -> list[tuple]:
        out, offset = [], 0
        for doc, start, total, ids in window_pieces:
            n = len(ids) >> 2
            out.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, ids if with_ids else None))
            offset += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(path, ranks_path)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        sequence = part << 32
        opened = OpenWindows(window, open_windows)
        done: list[tuple] = []
        for batch in batches:
            for some in chunks(batch, "text"):
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = tokens.encode(text or "") + end
                    total = len(ids) >> 2
                    for start in range(0, total, window):
                        piece = doc, start, total, ids[4 * start:4 * (start + window)]
                        closed = [[piece]] if len(piece[3]) == 4 * window else opened.add(piece)
                        for pieces in closed:
                            done += [(*r, False) for r in rows(pieces, sequence, keep_ids)]
                            sequence += 1
                yield _batch(done, part)
                done = []
        for pieces in opened.windows:
            done += [(*r, True) for r in rows(pieces, sequence, True)]
            sequence += 1
        yield _batch(done, part)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
        filled = frame.groupby("sequence_id")["length"].transform("sum")
        frame = frame.assign(filled=filled).sort_values(
            ["filled", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        sequence = _MERGED | int(frame["merge"].iloc[0]) << 32
        out, current, room = [], [], window
        for doc, start, total, ids in zip(frame["doc_id"].tolist(), frame["start"], frame["doc_tokens"], frame["ids"]):
            piece = (doc, int(start), int(total), ids)
            while len(piece[3]) >> 2 >= room:
                head, piece = _cut(piece, room)
                out += rows([*current, head], sequence, keep_ids)
                current, room, sequence = [], window, sequence + 1
            if piece[3]:
                current.append(piece)
                room -= len(piece[3]) >> 2
        out += rows(current, sequence, keep_ids)
        table = pd.DataFrame(out, columns=[f.split()[0] for f in _PIECE.split(", ")], dtype=object)
        return table

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialise(source.mapInArrow(releasing(run), f"{_PIECE}, open boolean, part long"), "packing")
    names = [f.split()[0] for f in _PIECE.split(", ")]
    closed = placed.where(~F.col("open")).select(*names)
    merged = placed.where("open").withColumn(
        "merge", F.floor(F.col("part") / PARTITIONS_PER_MERGE)).groupBy("merge").applyInPandas(merge, _PIECE)
    return closed.unionByName(merged)


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in range(9)]
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
    names = [f.split()[0] for f in _PIECE.split(", ")] + ["open", "part"]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int64())], names)
