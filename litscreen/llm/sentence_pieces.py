"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A sequence of pieces is the model's encoding of a text exactly if every two
neighbours are the encoding of their own joined text: no merge then crosses a
boundary. So pieces are laid from left to right, the longest match first
(Aho-Corasick over reversed pieces gives all matches that begin at a place).
A piece is laid if merging it anew together with its predecessor gives the two
back. A prefix has one encoding only, so a place from which no rest can be laid
is marked in a bitfield and never tried again.

No merge joins two characters that stand side by side in no piece. Texts are
cut between such characters, and the ids of short chunks are kept.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from litscreen.llm.common import byte_slices, table
from litscreen.llm.tokens import in_worker

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_SURFACE = " ⁇ "  # fixed value: what the library decodes the unknown id to
KEPT_CHUNKS = 400_000  # entries of each of the two memories of a worker
KEPT_LENGTH = 64  # of a chunk that is kept
SLICE = 1 << 20  # characters that are cut at a time
WINDOW = 4096  # characters whose matches are held at a time
SLICE_BYTES = 8 << 20  # texts that are worked on at a time
#: texts that tell a model whose normaliser or prefix differs from those that are built here
PROBES = ["", " ", "a", " a  b ", "A\tb\n\nc ", "ﬁ ½ ① é é", "\U0001d11e\x00<s></s><0x41>", "▁x▁"]

codecs.register_error("byte by byte", lambda error: ("�", error.start + 1))


class PieceModel:
    """Pieces of a merge-type model with byte fallback, identity normalisation and a blank put in front."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [library.unk_id()] * 256
        self.surfaces: list[bytes] = []
        self.led: set[int] = set()  # pieces that begin with a blank
        for number in range(library.get_piece_size()):
            piece, surface = library.id_to_piece(number), b""
            if library.is_byte(number):
                byte = int(piece[3:5], 16)
                self.byte_ids[byte], surface = number, bytes([byte])
            elif library.is_unknown(number):
                surface = UNKNOWN_SURFACE.encode()
            elif not library.is_control(number):
                self.ids[piece], self.scores[piece] = number, library.get_score(number)
                surface = piece.replace(BLANK, " ").encode()
                if piece.startswith(BLANK):
                    self.led.add(number)
            self.surfaces.append(surface)

        chars = sorted(set("".join(self.ids)))
        self.char_number = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.char_number[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.n_chars = len(chars) + 1
        self.together = np.zeros(self.n_chars**2, bool)  # whether two characters stand side by side in a piece
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            numbers = self.char_number[list(map(ord, piece))].astype(np.int64)
            self.together[numbers[:-1] * self.n_chars + numbers[1:]] = True
            self.matcher.add_word(piece[::-1], piece)
        self.matcher.make_automaton()
        self.longest = max(map(len, self.ids), default=1)
        self.agreeing: dict[tuple[str | None, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}
        for probe in PROBES:
            if self.encode(probe).tolist() != library.encode(probe):
                raise ValueError(f"{path}: the model normalises or merges in a way that is not supported, see {probe!r}")

    # ---- encoding ---------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text of any length; an empty one has none."""
        if not text:
            return np.zeros(0, np.int32)
        parts = []
        for chunks in self._chunks(BLANK + text.replace(" ", BLANK)):
            found = list(map(self.known.get, chunks))
            if None in found:
                found = [self._learn(c) if f is None else f for c, f in zip(chunks, found)]
            parts.append(np.fromiter(chain.from_iterable(found), np.int32))
        return np.concatenate(parts)

    def _chunks(self, text: str) -> Iterator[list[str]]:
        """The text cut wherever no piece can reach across, slice by slice."""
        at, size = 0, SLICE
        while at < len(text):
            part = text[at : at + size]
            numbers = self.char_number[np.frombuffer(part.encode("utf-32-le"), "<u4")].astype(np.int64)
            cuts = (np.flatnonzero(~self.together[numbers[:-1] * self.n_chars + numbers[1:]]) + 1).tolist()
            if at + size >= len(text):
                cuts.append(len(part))
            if not cuts:
                size *= 2  # a chunk longer than a slice
                continue
            yield [part[i:j] for i, j in zip([0, *cuts], cuts)]
            at, size = at + cuts[-1], SLICE

    def _learn(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk that is not in memory; of two generations the older one is forgotten."""
        ids = self.known.get(chunk)  # it may have come up earlier in the same slice
        if ids is not None:
            return ids
        ids = self.known_before.get(chunk)
        if ids is None:
            ids = tuple(chain.from_iterable(map(self._ids_of, self._search(chunk))))
        if len(chunk) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_CHUNKS:
                self.known, self.known_before = {}, self.known
            self.known[chunk] = ids
        return ids

    def _ids_of(self, piece: str) -> list[int]:
        number = self.ids.get(piece)
        return [self.byte_ids[b] for b in piece.encode()] if number is None else [number]

    def _search(self, chunk: str) -> list[str]:
        """Pieces of a chunk by backtracking."""
        matches = self._matches(chunk)
        failed = bytearray(len(chunk) // 8 + 1)
        pieces: list[str] = []
        choices = [0]  # per laid piece, and for the next one: which match is tried
        at, last = 0, None
        while at < len(chunk):
            found = matches(at)
            for choice in range(choices[-1], len(found)):
                piece = found[choice]
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self._agree(last, piece):
                    choices[-1] = choice
                    choices.append(0)
                    pieces.append(piece)
                    at, last = end, piece
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                choices.pop()
                at -= len(pieces.pop())
                last = pieces[-1] if pieces else None
                choices[-1] += 1
        return pieces

    def _matches(self, chunk: str) -> Callable[[int], list[str]]:
        """Gives the pieces that begin at a place, longest first; those of few windows are held at a time."""
        windows: dict[int, list[list[str]]] = {}

        def window_of(start: int) -> list[list[str]]:
            part = chunk[start : start + WINDOW + self.longest - 1]
            found: list[list[str]] = [[] for _ in part]
            last = len(part) - 1
            for end, piece in self.matcher.iter(part[::-1]):
                found[last - end].append(piece)
            for pieces, char in zip(found, part):
                if char not in self.ids:
                    pieces.append(char)  # a character that is no piece stands for its bytes
            return found

        def at(place: int) -> list[str]:
            number, inside = divmod(place, WINDOW)
            if number not in windows:
                while len(windows) > 2:
                    del windows[next(iter(windows))]
                windows[number] = window_of(number * WINDOW)
            return windows[number][inside]

        return window_of(0).__getitem__ if len(chunk) <= WINDOW else at

    def _agree(self, last: str | None, piece: str) -> bool:
        """Whether merging both anew gives them back."""
        pair = (last, piece)
        found = self.agreeing.get(pair)
        if found is None:
            if len(self.agreeing) >= KEPT_CHUNKS:
                self.agreeing.clear()
            expected = [piece] if last is None else [last, piece]
            found = self.agreeing[pair] = self._merged("".join(expected)) == expected
        return found

    def _merged(self, text: str) -> list[str]:
        """The encoding of a short text by its merges: the best score first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    # ---- decoding ---------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that make no character become the replacement character one by one."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        if next((i for i in ids if self.surfaces[i]), None) in self.led:
            data = data[1:]  # the blank that encoding puts in front
        return data.decode(errors="byte by byte")


def _model(path: str | None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return in_worker(f"pieces {path}", lambda: PieceModel(path))


def encode_texts(docs: DataFrame, text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``row`` (struct of the other columns), ``ids`` and ``decoded`` for every row of ``docs``, whole texts.

    ``ids`` are those that the model's library gives without begin and end ids,
    ``decoded`` is their text. A null or empty text has no ids and an empty text.
    Very long texts are cut and matched piece by piece; repeated rows get equal
    results; an empty table gives no rows; other columns may have any names.
    ``model_path`` must name the file on every executor; without it, each takes
    the one of its installed package.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                ids = [model.encode(t or "") for t in part.column("text").to_pylist()]
                decoded = [model.decode(i.tolist()) for i in ids]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column("row"), lists, pa.array(decoded)], ["row", "ids", "decoded"])

    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    schema = StructType(
        [rows.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    )
    return rows.mapInArrow(encode, schema)


def op11_pieces(spark, sf_dir):
    """Number and digests of the ids and of the decoded text of every document."""
    done = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
