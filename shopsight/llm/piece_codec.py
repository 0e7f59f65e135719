"""SentencePiece encoding and decoding by vectorised merge rounds (operator 9).

A text becomes ``_`` + text with blanks as ``_`` (the model's own normalisation).  No piece
holds a blank after another character, nor one of the ASCII characters that are pieces by
themselves only, so the text falls into segments that merges never cross.  The distinct
segments of a batch are encoded together: one flat array of symbols, the rank of every
adjacent pair, per segment the smallest rank, its leftmost pair merged in all segments at
once, the array compacted; segments leave when no pair remains.  Documents are then strung
together from segment results.  Segments over ``LONG`` symbols (text without any blank) go
through the same merges one by one from a heap, as a round costs their whole length.

Symbols that end up outside the vocabulary become the byte pieces of their UTF-8 form.
Decoding joins the pieces' bytes and drops the one blank that encoding put in front.

Defined cases: null and empty texts encode to the end id alone and decode to the empty
text; U+2581 is a blank, as in the library; repeated rows are encoded each; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shopsight.llm import textarrays as ta

LONG = 256
NONE = np.int32(2**31 - 1)
SPACE = "▁"


class Pieces:
    """Vocabulary of a BPE model with byte fallback, as lookup arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.eos = sp.eos_id()
        plain = {sp.id_to_piece(i): i for i in range(n)
                 if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.array([byte[b] for b in range(256)], np.int32)
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        # symbols: pieces, then single characters that only occur inside longer pieces
        symbol = dict(plain)
        for p in plain:
            for c in p:
                symbol.setdefault(c, n + len(symbol) - len(plain))
        self.size, self.vocab = n + len(symbol) - len(plain), n
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        left, right, to = [], [], []
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i)
        self.key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        self.to = np.array(to, np.int32)
        self.rank = np.append(rank[self.to], NONE)                # last entry: no such pair
        self.bits = max(12, int(len(to)).bit_length() + 2)
        slot = self._slot(self.key)
        self.first = np.full(1 << self.bits, -1, np.int32)
        self.next = np.full(len(to), -1, np.int32)
        for i, s in enumerate(slot.tolist()):
            self.next[i], self.first[s] = self.first[s], i
        several = set().union(*[p for p in plain if len(p) > 1])
        self.alone = np.array([b < 128 and b != 0x20 and chr(b) not in several for b in range(256)])
        surface = [b""] * n
        for p, i in plain.items():
            surface[i] = p.replace(SPACE, " ").encode()
        for b, i in byte.items():
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.decimal = np.array([str(i) for i in range(n)], object)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(ta.U) * ta.U(0x9E3779B97F4A7C15)) >> ta.U(64 - self.bits)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of each symbol pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -1
        at = self.first[self._slot(key)]
        todo = np.flatnonzero((at >= 0) & (self.key[at] != key))
        while len(todo):
            at[todo] = self.next[at[todo]]
            rest = at[todo]
            todo = todo[(rest >= 0) & (self.key[rest] != key[todo])]
        return at

    def merge_rounds(self, sym: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All merges of the segments sym[off[i]:off[i + 1]]: the remaining symbols, the index
        of the first original symbol of each, and the new offsets."""
        n = len(off) - 1
        at = np.arange(len(sym))
        seg = ta.owner(off)
        last = np.zeros(len(sym), bool)
        last[off[1:] - 1] = True
        done_sym, done_at, done_seg = [], [], []
        pair = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(~last)
        pair[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            rank = self.rank[pair]
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = least == NONE
            if over.any():
                done_sym.append(sym[over]), done_at.append(at[over]), done_seg.append(seg[over])
                go = ~over
                sym, at, seg, last, pair, rank, least = (x[go] for x in (sym, at, seg, last, pair, rank, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            hit = hit[np.concatenate([[True], seg[hit][1:] != seg[hit][:-1]])]       # leftmost of each segment
            sym[hit] = self.to[pair[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))                                          # where the merged symbols go
            sym, at, seg, last, pair = (x[keep] for x in (sym, at, seg, last, pair))
            before = now - 1
            before = before[(before >= 0) & (seg[before] == seg[now])]
            fresh = np.concatenate([now, before])
            pair[fresh] = -1
            fresh = fresh[~last[fresh]]
            pair[fresh] = self.pair(sym[fresh], sym[fresh + 1])
        if not done_sym:
            return sym, at, off
        seg = np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        counts = np.bincount(seg, minlength=n)
        return (np.concatenate(done_sym)[order], np.concatenate(done_at)[order],
                np.concatenate([[0], np.cumsum(counts)]))

    def merge_heap(self, sym: list[int]) -> tuple[list[int], list[int]]:
        """The same merges for one long segment: best pair first, leftmost among equals."""
        n = len(sym)
        arr = np.array(sym, np.int32)
        pair = self.pair(arr[:-1], arr[1:]).tolist()
        heap = [(int(self.rank[p]), i, sym[i], sym[i + 1]) for i, p in enumerate(pair) if p >= 0]
        heapq.heapify(heap)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def offer(i: int, j: int) -> None:
            p = int(self.pair(np.array([sym[i]]), np.array([sym[j]]))[0])
            if p >= 0:
                heapq.heappush(heap, (int(self.rank[p]), i, sym[i], sym[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = int(self.to[self.pair(np.array([a]), np.array([b]))[0]])
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                offer(i, nxt[i])
            if prv[i] >= 0:
                offer(prv[i], i)
        left = [i for i in range(n) if alive[i]]
        return [sym[i] for i in left], left

    def encode_segments(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """Ids of byte segments (0x20 is the blank): ids and n + 1 offsets."""
        flat = ta.take_ranges(data, starts, lens)
        blank = flat == 0x20
        chars = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        head = (flat & 0xC0) != 0x80
        coff = np.concatenate([[0], np.cumsum(np.add.reduceat(head.astype(np.int64), np.cumsum(lens) - lens))]) \
            if len(lens) else np.zeros(1, np.int64)
        sym = self.of_char[chars]
        sym[blank[head]] = self.of_char[ord(SPACE)]
        sizes = np.diff(coff)
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            short = np.flatnonzero(sizes <= LONG)
            parts = self.merge_rounds(ta.take_ranges(sym, coff[short], sizes[short]),
                                      np.concatenate([[0], np.cumsum(sizes[short])]))
            ssym, sat, soff = parts
            base = np.repeat(coff[short] - np.concatenate([[0], np.cumsum(sizes[short])[:-1]]), sizes[short])
            counts = np.zeros(len(sizes), np.int64)
            counts[short] = np.diff(soff)
            heaps = [self.merge_heap(sym[coff[i]:coff[i + 1]].tolist()) for i in long]
            counts[long] = [len(h[0]) for h in heaps]
            off = np.concatenate([[0], np.cumsum(counts)])
            out, at = np.zeros(off[-1], np.int32), np.zeros(off[-1], np.int64)
            place = np.repeat(off[:-1][short], np.diff(soff)) + ta.spread_counts(np.diff(soff))
            out[place], at[place] = ssym, sat + base[sat]
            for i, (s, a) in zip(long, heaps):
                out[off[i]:off[i + 1]], at[off[i]:off[i + 1]] = s, coff[i] + np.array(a, np.int64)
        else:
            out, at, off = self.merge_rounds(sym, coff)
        odd = (out < 0) | (out >= self.vocab)
        if odd.any():                                     # byte pieces of characters without one of their own
            heads = np.append(np.flatnonzero(head), len(flat))
            first = heads[at]
            width = np.where(odd, heads[np.minimum(at + 1, len(heads) - 1)] - first, 1)
            ids = np.repeat(out, width)
            bad = np.repeat(odd, width)
            ids[bad] = self.byte_id[flat[(np.repeat(first, width) + ta.spread_counts(width))[bad]]]
            off = np.concatenate([[0], np.cumsum(width)])[off]
            out = ids
        return out, off

    def segments(self, data: np.ndarray, off: np.ndarray):
        """Segment starts and ends of normalised texts, and the n + 1 segment offsets."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        alone, blank = self.alone[data], data == 0x20
        begin = alone | blank
        begin[1:] &= ~(blank[1:] & blank[:-1])
        begin[1:] |= alone[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, off)

    def normalise(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes with blanks as 0x20 and one blank before every text that is not empty."""
        data, off = ta.bytes_of(texts)
        mark = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
        mark = mark[(data[mark + 1] == 0x96) & (data[mark + 2] == 0x81)]
        if len(mark):
            data = data.copy()
            data[mark] = 0x20
            keep = np.ones(len(data), bool)
            keep[mark + 1] = keep[mark + 2] = False
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            data = data[keep]
        some = np.diff(off) > 0
        data = np.insert(data, off[:-1][some], 0x20)
        return data, off + np.concatenate([[0], np.cumsum(some)])

    def decode_ids(self, ids: np.ndarray) -> np.ndarray:
        return ta.take_ranges(self.surface, self.surface_at[ids], self.surface_len[ids])

    def encode(self, texts: pa.Array):
        """Distinct segments' ids and offsets, the segment of every place, place offsets."""
        data, off = self.normalise(texts)
        starts, ends, soff = self.segments(data, off)
        h = ta.fingerprints(data, starts, ends)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        ids, ioff = self.encode_segments(data, starts[first], (ends - starts)[first])
        return ids, ioff, which, soff


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in ta.text_batches(batches):
            ids, ioff, which, soff = p.encode(b.column("text"))
            counts = np.diff(ioff)[which]
            flat = ta.take_ranges(ids, ioff[:-1][which], counts)
            off = np.concatenate([[0], np.cumsum(counts)])[soff]
            with_end = np.insert(flat, off[1:], p.eos)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), ta.list_array(with_end.astype(np.int32), off + np.arange(len(off)))],
                names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every text, the end id last."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(path), f"doc_id {_id_type(docs)}, ids array<int>")


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            texts = []
            for ids in b.column("ids"):
                raw = p.decode_ids(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else ()
                texts.append(bytes(raw[1:] if len(raw) and raw[0] == 0x20 else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), f"doc_id {_id_type(encoded)}, text string")


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in ta.text_batches(batches):
            ids, ioff, which, soff = p.encode(b.column("text"))
            raw = p.decode_ids(ids).tobytes()
            roff = np.concatenate([[0], np.cumsum(p.surface_len[ids])])[ioff].tolist()
            names = p.decimal[ids].tolist()
            cuts = ioff.tolist()
            digits = np.array([" ".join(names[i:j]) for i, j in zip(cuts, cuts[1:])] + [""], object)
            surface = np.array([raw[i:j] for i, j in zip(roff, roff[1:])] + [b""], object)
            counts = np.concatenate([[0], np.cumsum(np.diff(ioff)[which])])[soff]
            end = str(p.eos)
            id_sha, text_sha = [], []
            for lo, hi in zip(soff[:-1].tolist(), soff[1:].tolist()):
                w = which[lo:hi]
                s = " ".join([*digits[w].tolist(), end])
                t = b"".join(surface[w].tolist())
                id_sha.append(hashlib.sha256(s.encode()).hexdigest())
                text_sha.append(hashlib.sha256(t[1:] if t[:1] == b" " else t).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(counts) + 1), pa.array(id_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, decode its ids,
    and keep only digests of both."""
    return docs.select("doc_id", "text").mapInArrow(
        _digester(path), f"doc_id {_id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
