"""SentencePiece BPE ids from a table of each prefix's last token, and texts from ids.

Merging always takes the best pair of neighbours, by score, then from the left.  A row of tokens is what merging makes of
its text exactly if every two neighbours are what it makes of theirs (they are *compatible*), so each prefix of a text has
one last token: the piece that ends there, found by an automaton over all pieces, and that is compatible with the last
token of the prefix before it.  One pass fills the table; the ids are read backwards from the end of the text.

Two neighbours are tested on the pieces that stand at their common border while each of them is being built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import key_and_text, slices

# The character that stands for a space in pieces.
SPACE = "▁"

# Chunks and pairs that a worker keeps, and characters of the longest chunk that is kept.
KEPT_CHUNKS, KEPT_PAIRS, KEPT_CHARS = 400_000, 1_000_000, 48

_ENCODERS: dict[str, "PieceEncoder"] = {}


def merged(text: str, cost: dict[str, float]) -> tuple[list[str], list[tuple[float, list[str]]]]:
    """What merging makes of a short text, by trying all pairs at every step; and (cost, parts left of it) of each step.

    ``cost`` holds every piece; the least cost goes first, then the leftmost pair.
    """
    parts, steps = list(text), []
    while len(parts) > 1:
        pairs = [(cost[p], i) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in cost]
        if not pairs:
            break
        least, i = min(pairs)
        steps.append((least, parts))
        parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2 :]
    return parts, steps


class PrefixTable:
    """Encodes strings with the pieces ``names`` (by id, from 0 on) of given costs, the less the sooner merged.

    Every character of a piece must be a piece itself; other characters stay as they are.
    """

    def __init__(self, names: dict[int, str], costs: dict[int, float]):
        import ahocorasick

        self.names, self.cost = names, {name: costs[i] for i, name in names.items()}
        if not set().union(*names.values()) <= set(self.cost):
            raise ValueError("a character of a piece is no piece")
        # Of each piece that merging makes of its own text: what stands at its left and right end while it is built, each
        # with the cost of the step that ends that.  Pieces whose steps don't come in order of cost are kept apart.
        self.left: dict[int, list[tuple[str, float]]] = {}
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.unordered: set[int] = set()
        # The id before a text's first token and that of every character that is no piece: it goes with any other.
        self.free = max(names, default=0) + 1
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, name in names.items():
            parts, steps = merged(name, self.cost)
            if parts != [name]:
                continue  # no text gives it
            if len(name) > 1:
                self.automaton.add_word(name, (i, len(name)))
            paid = [c for c, _ in steps]
            if paid != sorted(paid):
                self.unordered.add(i)
            self.left[i] = self._ends([(c, p[0]) for c, p in steps], name)
            self.right[i] = self._ends([(c, p[-1]) for c, p in steps], name)
        # A pair (a, b) is looked up as a * base + b, so tokens to the left are kept as a * base.
        self.base = self.free + 1
        self.single = {name: i * self.base for i, name in names.items() if len(name) == 1}
        self.sizes = {i * self.base: (i, len(name)) for i, name in names.items()}
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def _ends(seen: list[tuple[float, str]], piece: str) -> list[tuple[str, float]]:
        """(part, cost of the step that ends it), from a row of (cost of a step, part before it)."""
        after = [part for _, part in seen[1:]] + [piece]
        return [(part, cost) for (cost, part), later in zip(seen, after) if later != part] + [(piece, inf)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces ``a`` and ``b`` side by side."""
        if a == self.free or b == self.free:
            return True
        if a in self.unordered or b in self.unordered:
            both = [self.names[a], self.names[b]]
            return merged("".join(both), self.cost)[0] == both
        rights, lefts, cost_of = self.right[a], self.left[b], self.cost.get
        i = j = 0
        while True:
            (x, end_x), (y, end_y) = rights[i], lefts[j]
            cost = cost_of(x + y)
            # A step inside ``a`` lies left of the border and goes before one across at equal cost, one inside ``b`` after.
            if cost is not None and cost < end_x and cost <= end_y:
                return False
            if end_x == end_y == inf:
                return True
            if end_x <= end_y:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[int]:
        """The ids of a text's pieces in order; a character c that is no piece stands as ``~ord(c)``."""
        pairs, base = self.pairs, self.base
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        free, known, compatible, single = self.free * base, pairs.get, self.compatible, self.single.get
        # The last token of the prefix that ends with character i: exactly one piece fits, the character itself if no longer
        # one does.  The entry behind them, also -1, is the empty prefix's.
        last = [single(c, free) for c in text]
        last.append(free)
        done = -1
        for end, (piece, size) in self.automaton.iter(text) if len(self.automaton) else ():
            if end != done:
                pair = last[end - size] + piece
                fits = known(pair)
                if fits is None:
                    fits = pairs[pair] = compatible(pair // base, piece)
                if fits:
                    last[end] = piece * base
                    done = end
        out, at, sizes = [], len(text) - 1, self.sizes
        while at >= 0:
            if last[at] == free:
                out.append(~ord(text[at]))
                at -= 1
            else:
                piece, size = sizes[last[at]]
                out.append(piece)
                at -= size
        out.reverse()
        return out


class PieceEncoder:
    """Ids of whole texts by a SentencePiece BPE model file without user-defined symbols."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError(f"{path} has unused pieces")
        names = {i: model.id_to_piece(i) for i in sorted(set(range(size)).difference(special))}
        self.table = PrefixTable(names, {i: -model.get_score(i) for i in names})
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in special if model.is_byte(i)}
        # No piece goes on with a space after something else: texts fall apart into words with the spaces before them.
        apart = all(SPACE not in p.lstrip(SPACE) for p in names.values())
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else r"(?s).+").findall
        self.digits = [str(i) for i in range(size)]
        # Chunks met lately, and those met before: what stays in use moves on, the rest is forgotten.
        self.kept: dict[str, tuple[list[int], str]] = {}
        self.older: dict[str, tuple[list[int], str]] = {}

    def _unknown(self, tokens: list[int]) -> list[int]:
        """Tokens with the bytes of characters that are no pieces, or one unknown id for a run of them."""
        out: list[int] = []
        for token, before in zip(tokens, [0, *tokens]):
            if token >= 0:
                out.append(token)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(~token).encode())
            elif before >= 0:
                out.append(self.model.unk_id())
        return out

    def _chunk(self, chunk: str) -> tuple[list[int], str]:
        ids = self.table.tokens(chunk)
        if min(ids) < 0:
            ids = self._unknown(ids)
        return ids, ",".join([self.digits[i] for i in ids])

    def chunks(self, text: str) -> list[tuple[list[int], str]]:
        """(ids, the same as a text) of the words of a text in order."""
        if len(self.kept) > KEPT_CHUNKS:
            self.kept, self.older = {}, self.kept
        kept, out = self.kept, []
        for chunk in self.cut(self.model.normalize(text)):
            found = kept.get(chunk)
            if found is None:
                found = self.older.get(chunk) or self._chunk(chunk)
                if len(chunk) <= KEPT_CHARS:
                    kept[chunk] = found
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable([ids for ids, _ in self.chunks(text)]))


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def default_model() -> str:
    """Path of the 32k piece model; any other SentencePiece BPE model file can be named instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, in any order: the ids of the whole text, without begin or end ids.

    A null text counts as empty and has no ids; a null doc_id stays null.  Repeated rows come back as often.  A text of any
    length is encoded in one pass with a table entry a character of its longest word.  An empty table gives no rows;
    other columns are not read.
    """
    path = model or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = [encoder(path).encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return key_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the text the library makes of the ids; null or no ids: an empty text."""
    path = model or default_model()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            texts = [encoder(path).model.decode(ids or []) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its ids and what they decode to, as digests.

    The ids are those of ``encode_documents``, the texts those of ``decode_documents``, with the same defined cases; both are
    digested where they are made, so that neither leaves the task.
    """
    path = model or default_model()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own, counts, ids_sha, text_sha = encoder(path), [], [], []
            for text in part.column("text").to_pylist():
                chunks = own.chunks(text)
                ids = list(chain.from_iterable([x for x, _ in chunks]))
                counts.append(len(ids))
                ids_sha.append(sha256(",".join([x for _, x in chunks if x]).encode()).hexdigest())
                text_sha.append(sha256(own.model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return key_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(digest, schema)
