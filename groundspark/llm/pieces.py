"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. A text is cut before every run of
spaces (no piece of such a vocabulary has a space after another character, which is asserted
when the model is loaded), so each cut part is merged alone. Short parts are merged many at a
time: the agenda of each is a row of a matrix of pair ranks, and every round takes each row's
best pair (leftmost on ties). Long parts use a heap. Each Arrow batch is checked against the
sentencepiece library before its rows leave the task.

Defined results: null text counts as empty; an empty text has no ids; a null id list decodes to
an empty text. Extra columns pass through; a column with the name of the output is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, short_batches, slices

CACHED = 250_000  # parts remembered by a Python worker
SHORT = 32  # characters of a part that is merged in the matrix
SLICE = 1_000_000  # characters taken at a time
FREE = np.iinfo(np.int32).max
PART = re.compile(" +[^ ]*")  # a part with all spaces before it


class Vocabulary:
    """A merge-type model: pair table, bytes of each id, and the library's own processor."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any("▁" in p.lstrip("▁") or any(c not in ids for c in p) for p in ids) or "\n" in ids or sp.normalize("a\t  ① ") != "▁a\t▁▁①▁":
            raise ValueError("only BPE models with the identity normalizer, a dummy prefix and spaces at the start of pieces")
        rank = np.empty(n, np.int32)
        rank[np.argsort([-sp.get_score(i) for i in range(n)], kind="stable")] = np.arange(n)
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs = {k: (int(rank[i]), i) for k, i in pairs.items()}
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.out = np.array(list(pairs.values()), np.int32)[order]
        self.rank = rank
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        self.char_of = np.full(max(map(ord, self.char)) + 1, -1, np.int64)
        self.char_of[[ord(c) for c in self.char]] = list(self.char.values())
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = [
            b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.spaced = np.array([not special[i] and p.startswith("▁") for i, p in enumerate(pieces)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.len = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)

    def remember(self, parts: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        """Adds parts with their ids, which stand one after the other in flat."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        n, m = len(self.known), len(parts)
        while n + m > len(self.at):
            self.at, self.len = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.len))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[n : n + m] = self.used + np.cumsum(lens) - lens
        self.len[n : n + m] = lens
        self.used += len(flat)
        self.known.update(zip(parts, range(n, n + m), strict=True))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merged piece of each pair; FREE where there is none."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        merged = np.where(self.keys[at] == key, self.out[at], -1)
        return np.where(merged >= 0, self.rank[merged], FREE), merged

    def merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """Merges every row of sym (ids; -1 after its end, below -1 unknown) to the end."""
        done = sym.copy()
        live = np.arange(len(sym))
        rank, merged = self.look_up(sym[:, :-1], sym[:, 1:])
        while len(live):
            best = rank.argmin(1)
            row = np.arange(len(live))
            go = rank[row, best] < FREE
            if not go.all():
                done[live[~go]] = sym[~go]
                live, sym, rank, merged, best = live[go], sym[go], rank[go], merged[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            new = merged[row, best]
            width = sym.shape[1]
            cols = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            sym = np.take_along_axis(np.pad(sym, ((0, 0), (0, 1)), constant_values=-1), cols, 1)
            sym[row, best] = new
            gone = np.arange(width - 1)[None, :] + (np.arange(width - 1)[None, :] >= best[:, None])
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=FREE), gone, 1)
            merged = np.take_along_axis(np.pad(merged, ((0, 0), (0, 1)), constant_values=-1), gone, 1)
            for side in (best - 1, best):
                ok = (side >= 0) & (side < width - 1)
                r, s = row[ok], side[ok]
                rank[r, s], merged[r, s] = self.look_up(sym[r, s], sym[r, s + 1])
        return done

    def agenda(self, sym: list[int]) -> list[int]:
        """Merges one long row with a heap of (rank, place, length)."""
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        sym = list(sym)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and (hit := self.pairs.get((sym[i], sym[j]))):
                heapq.heappush(heap, (hit[0], i, j, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = self.pairs[a, b][1], FREE
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in sym if x != FREE]

    def learn(self, parts: list[str]) -> None:
        """Encodes parts that aren't known yet."""
        short = sorted((p for p in parts if len(p) < SHORT), key=lambda p: len(p) - (p[:1] == "\n"))
        width = np.array([len(p) + (p[:1] != "\n") for p in short], np.int64)
        joined = "".join([spelt(p) for p in short])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = np.where(points < len(self.char_of), self.char_of[np.minimum(points, len(self.char_of) - 1)], -1)
        symbols = np.where(symbols < 0, -2 - points, symbols).astype(np.int32)
        ends = np.cumsum(width)
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            a, b = np.searchsorted(width, [low, high], "right")
            if a < b:
                sym = np.full((b - a, high), -1, np.int32)
                sym[np.arange(high)[None, :] < width[a:b, None]] = symbols[ends[a] - width[a] : ends[b - 1]]
                sym = self.merge_rows(sym)
                keep = sym != -1
                flat, lens = self.fall_back(sym[keep], keep.sum(1))
                self.check(short[a:b], flat, lens)
                self.remember(short[a:b], flat, lens)
        for p in parts:
            if len(p) >= SHORT:
                ids = np.array(self.agenda([self.char.get(c, -2 - ord(c)) for c in spelt(p)]), np.int32)
                flat, lens = self.fall_back(ids, np.array([len(ids)]))
                self.check([p], flat, lens)
                self.remember([p], flat, lens)

    def fall_back(self, flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spells unknown characters with the ids of their bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, lens
        spelt = [[self.byte[b] for b in chr(-2 - x).encode()] for x in flat[odd].tolist()]
        size = np.ones(len(flat), np.int64)
        size[odd] = [len(x) for x in spelt]
        owner = np.repeat(np.arange(len(lens)), lens)
        wide = np.repeat(flat, size)
        wide[np.repeat(flat < 0, size)] = [y for x in spelt for y in x]
        return wide, np.bincount(owner, size, len(lens)).astype(np.int64)

    def check(self, parts: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        """Raises where the library encodes a part in another way."""
        theirs = [x[1:] if p[:1] == "\n" else x or [self.char["▁"]] for p, x in zip(parts, self.lib.encode(parts, num_threads=1), strict=True)]
        if [y for x in theirs for y in x] != flat.tolist() or [len(x) for x in theirs] != lens.tolist():
            raise ValueError("the agenda and the sentencepiece library differ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and how many each has."""
        parts: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                parts += cut(t)
            ends.append(len(parts))
        new = set(parts).difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.forget()
            new = set(parts)
        self.learn(list(new))
        part = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        lens = self.len[part].astype(np.int64)
        flat = self.ids[spread(self.at[part], lens)]
        return flat, np.diff(np.concatenate([[0], np.cumsum(lens)])[ends])

    def decode(self, flat: np.ndarray, lens: np.ndarray) -> pa.Array:
        """Texts of id lists, which stand one after the other in flat."""
        at, size = self.raw_at[flat], self.raw_len[flat]
        ends = np.cumsum(lens)
        first = (ends - lens)[lens > 0]
        first = first[self.spaced[flat[first]]]
        at[first] += 1
        size[first] -= 1
        data = self.raw[spread(at, size)]
        offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
        out = pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # byte ids that form no character
            out = pa.array([self.lib.decode(flat[b - n : b].tolist()) for b, n in zip(ends.tolist(), lens.tolist(), strict=True)], pa.large_string())
        return out


def cut(text: str) -> list[str]:
    """The parts of a text, each without its first space (the first part's is the dummy prefix).

    No merge crosses a line feed, which is no piece: parts that start with one have no space before.
    """
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.replace("\n", " \n").split(" ")
    out = []
    for p in PART.findall(" " + text):
        first, *rest = p.split("\n")
        out.append(first[1:])
        out += ["\n" + x for x in rest]
    return out


def spelt(part: str) -> str:
    """A part as the characters that are merged."""
    return part if part.startswith("\n") else "▁" + part.replace(" ", "▁")


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... at + size - 1 for each entry, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The model, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the ids of column text in the column out (array<int>), without the columns in drop."""
    short_batches(df.sparkSession)
    keep = [c for c in df.columns if c != out and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            column = batch.column(len(keep))
            for a, b in slices(np.array([len(x) if x else 0 for x in column.to_pylist()]), SLICE):
                flat, lens = words.encode(column.slice(a, b - a).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(keep))] + [ids], [*keep, out])

    return df.select(*keep, F.col(text).alias(free_name(df, "__text"))).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the text of the id lists in the column out, without the columns in drop."""
    short_batches(df.sparkSession)
    keep = [c for c in df.columns if c != out and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for batch in batches:
            column = batch.column(len(keep))
            sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in slices(sizes, SLICE):
                flat = column.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = words.decode(flat, sizes[a:b]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(keep))] + [texts], [*keep, out])

    return df.select(*keep, F.col(ids).alias(free_name(df, "__ids"))).mapInArrow(run, schema)


def digests(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's round trip."""
    encoded = encode(documents.select("doc_id", "text"), model, drop=("text",))
    encoded = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    decoded = decode(encoded, model, drop=("ids",))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
