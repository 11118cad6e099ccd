"""Packing documents into sequences of bounded length: first-fit decreasing in randomised groups.

Documents longer than a sequence give whole sequences first; what is left of each is packed with first-fit decreasing.
The bins of a group stand in a tournament tree whose inner nodes hold the largest free room below them, so the first bin
with enough room is found in one walk down.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import key_and_text, slices
from assay.llm.tokens import default_vocabulary, document_ids
from assay.session import cut

# Pieces of a group: many enough for tight bins, few enough for one task's memory.
GROUP_PIECES = 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; the longest pieces go first, each to the first bin with room.

    Equal lengths keep their given order.  No length may exceed ``capacity``.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length()) if n else 1
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of ``capacity``."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for key, ids in zip(part.column("doc_id").to_pylist(), document_ids(path, part.column("text").to_pylist(), end_id)):
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    out.append((key, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    texts = key_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(encode, PIECES)


def pack(cut_pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``.

    ``cut_pieces`` must be a stored table: its rows are dealt to groups by a hash of their place in it, so repeated rows
    and repeated ids are spread like all others.  ``sequence_id`` holds the group in its upper 32 bits and the bin in its
    lower ones.  A piece of full length is a sequence of its own.  No rows give no sequences.
    """
    n = cut_pieces.count()
    groups = max(1, -(-n // group_pieces))
    dealt = cut_pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), capacity)
        sequence = (rows.column("group").to_numpy() << 32) + bins
        return rows.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("group").applyInArrow(fill, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """All pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is one piece with the end id; a null ``doc_id`` stays null.  An empty table gives no rows.
    """
    return pack(cut(pieces(docs, capacity, vocabulary, end_id)), capacity)
