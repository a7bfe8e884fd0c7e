"""Problem 7: encoding of the whole corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's public pattern. The distinct pieces of a
batch become padded numpy matrices, one for each range of lengths. In every round each
row merges its leftmost pair of minimum rank, found by a hashed lookup of pairs, so
that every row loses one column and the matrix is compacted; rows without a pair leave.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("COLUMNSCOUT_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the public pattern that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this are encoded one by one.
LONG = 512
#: A worker remembers the ids of so many pieces; it only saves work, the ids are the same without.
REMEMBERED = 300_000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, id of the merged token), probed for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) + 1))) + 2)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys, first = np.unique(keys, return_index=True)  # of a repeated pair the first counts
        rank, merged = first.astype(np.int32), merged[first].astype(np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            _, one = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[one] = True
            put &= free
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[put], rank[put], merged[put]
            keys, rank, merged, slot = keys[~put], rank[~put], merged[~put], (slot[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no such pair, or an id is negative) and merged ids."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        rank, merged = np.full(keys.shape, NONE, np.int32), np.zeros(keys.shape, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[at])
        for _ in range(self.probes):
            if not len(at):
                break
            there = self.keys[slot]
            hit = there == keys[at]
            rank[at[hit]], merged[at[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            more = ~hit & (there != -1)
            at, slot = at[more], (slot[more] + 1) & (len(self.keys) - 1)
        return rank.reshape(shape), merged.reshape(shape)


class ByteBpe:
    """Encoder of one public byte-level BPE vocabulary file (json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]),
                               np.array([vocab[a + b] for a, b in pairs]))
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, np.ndarray] = {}

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece. A round merges all places of its minimum-rank pair: pairs with the
        new token always rank later, so merging the leftmost again and again gives the same."""
        rank, merged = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            if ids[at[0]] == ids[at[0] + 1]:  # in a run of equal ids every second place
                start = np.concatenate(([True], np.diff(at) > 1))
                run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids = ids.copy()
            ids[at] = merged[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            ids = ids[keep]
            if len(ids) < 2:
                break
            old_rank, old_merged = np.append(rank, NONE)[keep], np.append(merged, 0)[keep]
            at = place[at]
            touched = np.unique(np.concatenate((at, at - 1)))
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            old_rank[touched], old_merged[touched] = self.pairs.find(ids[touched], ids[touched + 1])
            rank, merged = old_rank[:-1], old_merged[:-1]
        return ids

    def _matrix(self, pieces: list[bytes], where: np.ndarray, out: list) -> None:
        """Encode the pieces at `where`, whose lengths are in one bucket."""
        lengths = np.array([len(pieces[i]) for i in where])
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(where), width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in where), np.uint8)]
        rank = np.full(ids.shape, NONE, np.int32)
        merged = np.zeros(ids.shape, np.int32)
        rank[:, :-1], merged[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(where):
            place = rank.argmin(axis=1)  # the leftmost of the least
            rows = np.arange(len(where))
            done = rank[rows, place] == NONE
            if done.any():
                for i, row in zip(where[done], ids[done]):
                    out[i] = row[row >= 0]
                where, ids, rank, merged, place = where[~done], ids[~done], rank[~done], merged[~done], place[~done]
                if not len(where):
                    break
                rows = np.arange(len(where))
            ids[rows, place] = merged[rows, place]
            keep = np.ones(ids.shape, bool)
            keep[rows, place + 1] = False
            shape = (len(where), ids.shape[1] - 1)
            ids, rank, merged = ids[keep].reshape(shape), rank[keep].reshape(shape), merged[keep].reshape(shape)
            for at in (place - 1, place):
                r = rows[(at >= 0)]
                a = at[at >= 0]
                right = np.where(a + 1 < shape[1], ids[r, np.minimum(a + 1, shape[1] - 1)], -1)
                rank[r, a], merged[r, a] = self.pairs.find(ids[r, a], right)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty piece."""
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
        bucket = np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
        for b in np.unique(bucket[lengths <= LONG]):
            where = np.flatnonzero((bucket == b) & (lengths <= LONG))
            step = max(1, (1 << 20) >> b)
            for k in range(0, len(where), step):
                self._matrix(pieces, where[k : k + step], out)
        return out

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the texts' offsets in them. A null or empty text has no ids."""
        cut = [self.pieces(t) if t else [] for t in texts]
        new = list({p for pieces in cut for p in pieces} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({p for pieces in cut for p in pieces})
        self.known.update(zip(new, self.encode_pieces([p.encode("utf-8") for p in new])))
        found = [self.known[p] for pieces in cut for p in pieces]
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        upto = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        ends = np.concatenate(([0], ends))
        return flat, np.concatenate(([0], ends[upto]))


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, made once a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def _blocks(batch: pa.RecordBatch, text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` bytes of text, so that memory doesn't follow the texts' length."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // most
    starts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(sizes)]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS,
                  vocabulary: str = VOCABULARY, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids) of every row: the token ids of the whole text, without special tokens.

    A null text and an empty text both have the empty list. Strings that look like a
    special token are ordinary text. Every row gives one row, repeated rows and rows
    with a null id included; other columns are ignored, whatever their names. With
    `counts_only` the result is (id, n_tokens long). Columns named in `keep` follow the result's. No shuffle.
    """
    path = os.path.join(tokenizers, vocabulary)
    id_type = documents.schema[id_col].dataType.simpleString()

    def encode(batches):
        bpe = encoder(path)
        for whole in batches:
            for batch in _blocks(whole, 1):
                flat, offsets = bpe.encode(batch.column(1).to_pylist())
                if counts_only:
                    result = pa.array(np.diff(offsets))
                else:
                    result = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
                columns = [batch.column(0), result, *batch.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    names = [id_col, "n_tokens" if counts_only else "ids", *keep]
    types = [id_type, "long" if counts_only else "array<int>", *(documents.schema[c].dataType.simpleString() for c in keep)]
    read = documents.select(documents[id_col].alias("c0"), documents[text_col].cast("string").alias("c1"), *(documents[c].alias(f"c{i + 2}") for i, c in enumerate(keep)))
    return read.mapInArrow(encode, ", ".join(f"c{i} {t}" for i, t in enumerate(types))).toDF(*names)
