"""Token ids as grammar-compressed shard files (operator 10).

Documents are ranged by id over tasks, each task encodes its texts with the ``tokenizers``
library (asked once per distinct piece: the pattern drops blanks, so a text's ids are its
pieces' ids), ends every document with ``END`` and writes blocks of about 8 MB of text.

Block format (one Parquet row): ``shard, block`` order the blocks by document id;
``doc_ids`` and ``doc_symbols`` give every document and its number of grammar symbols;
``symbols`` is the Re-Pair sequence, ``rules`` the symbol pairs behind the nonterminals
``base, base + 1, ...`` and ``lengths`` how many ids each nonterminal expands to, so that any
id range of a document is found from running lengths and only its symbols are expanded.
Pairs never cross documents.  ``width`` is the bytes per symbol.

Re-Pair: rounds count all adjacent pairs, give the frequent ones nonterminals and replace
them, the most frequent first, until no pair pays: ``RULE_BYTES`` a rule against ``width`` a
hit.  What counts as frequent falls by eighths down to what pays; within a step only pairs
that are new or were frequent are counted again.  Where the nonterminals use up two bytes,
rounds go on with four, unless the places left cannot make up for the wider symbols, and the
smaller of both results is kept.

Spark's own Parquet writer commits the files in the shared folder, so a lost executor's
blocks are written again and never seen twice.  Offsets: block totals are summed per
shard, shards in order, blocks within their shard.

Defined cases: null and empty texts are the end id alone; rows without doc_id come first;
repeated ids follow each other, ordered by text hash; extra columns are ignored; an empty
table writes no block and gives no rows.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm import textarrays as ta
from shopsight.llm.byte_codec import byte_alphabet
from shopsight.llm.common import small
from shopsight.session import scratch_path

END = 2
BLOCK_BYTES = 8 << 20    # of text
RULE_BYTES = 12          # a rule's pair and its length
SPLIT = "<|startoftext|>"

BLOCK_SCHEMA = ("shard int, block int, n_tokens bigint, base int, width int, doc_ids array<bigint>, "
                "doc_symbols array<int>, rules binary, lengths binary, symbols binary")


_KIND = np.full(256, 3, np.uint8)                          # 0 letter, 1 digit, 2 other ASCII, 3 part of a longer character
_KIND[:128] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Encoder:
    """The library's encoding, asked once per distinct piece of text.

    The tokenizer's pattern never joins an ASCII letter with other ASCII characters (but
    for an apostrophe), so words are cut there and ASCII is folded as the normaliser does.
    Words with an apostrophe or a part of a special token stay whole.  Results of up to
    ``keep`` pieces are kept for the next batches of the same Python worker.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # one thread a task
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.base, self.mark, self.keep = self.tok.get_vocab_size(), self.tok.token_to_id(SPLIT), keep
        self.byte_char = {b: c for c, b in byte_alphabet().items()}
        self.ends = np.zeros(self.base, bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, ta.U)
        self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _apart(self, pieces: list[str]) -> list[list[int]]:
        """Any pieces, kept apart by a special token; those that hold one go alone."""
        out: list[list[int]] = [[]] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if "<|" not in p and "|>" not in p]
        for lo in range(0, len(plain), 200):
            some = plain[lo:lo + 200]
            ids = np.array(self.tok.encode(SPLIT.join([pieces[i] for i in some]), add_special_tokens=False).ids, np.int32)
            for i, part in zip(some, np.split(ids, np.flatnonzero(ids == self.mark))):
                out[i] = part[part != self.mark].tolist()
        for i in set(range(len(pieces))) - set(plain):
            out[i] = self.tok.encode(pieces[i], add_special_tokens=False).ids
        return out

    def _letters(self, pieces: list[str]) -> list[list[int]]:
        """Pieces of letters only: each is one token run that closes with an end-of-word id."""
        out = []
        for lo in range(0, len(pieces), 100):
            some = pieces[lo:lo + 100]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            parts = [x.tolist() for x in np.split(ids, cut[:-1])]
            out += parts if len(cut) == len(some) and cut[-1] == len(ids) else self._apart(some)
        return out

    def _foreign(self, pieces: list[str]) -> list[list[int]]:
        """The same for letters beyond ASCII: folded together, then each as the bytes that the model knows."""
        folded = self.tok.normalizer.normalize_str(" ".join(pieces)).split(" ")
        if len(folded) != len(pieces):
            return self._letters(pieces)
        out: list[list[int]] = [[]] * len(pieces)
        odd = []
        for i, p in enumerate(folded):
            if p.isalpha():
                out[i] = [t.id for t in self.tok.model.tokenize(p.encode().decode("latin-1").translate(self.byte_char))]
            else:
                odd.append(i)                                # folding made something else of a letter
        for i, ids in zip(odd, self._apart([pieces[i] for i in odd])):
            out[i] = ids
        return out

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        model, foreign, rest = self.tok.model, [], []
        for i, p in enumerate(pieces):
            if not p.isalpha():
                rest.append(i)
            elif p.isascii():
                out[i] = [t.id for t in model.tokenize(p)]
            else:
                foreign.append(i)
        for some, how in ((foreign, self._foreign), (rest, self._apart)):
            for i, ids in zip(some, how([pieces[i] for i in some])):
                out[i] = ids
        return out

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes folded where safe, starts and ends of all pieces, the n + 1 piece offsets."""
        starts, ends, woff = ta.words(data, off)
        if not len(starts):
            return data, starts, ends, woff
        kind = _KIND[data]
        free = ~ta.BLANK[data]
        stop = np.flatnonzero((data == 39) | (data == 60))                  # ' and <
        whole = np.unique(np.searchsorted(starts, stop, "right") - 1)
        size = ends[whole] - starts[whole]
        free[np.repeat(starts[whole], size) + ta.spread_counts(size)] = False
        change = np.zeros(len(data), bool)
        change[1:] = free[1:] & free[:-1] & (kind[1:] < 3) & (kind[:-1] < 3) & (
            (kind[1:] != kind[:-1]) | (kind[1:] == 1))
        begin = np.zeros(len(data), bool)
        begin[starts] = True
        cuts = np.flatnonzero(change & ~begin)
        all_starts = np.sort(np.concatenate([starts, cuts]))
        all_ends = np.sort(np.concatenate([ends, cuts]))
        return np.where(free, _FOLD[data], data), all_starts, all_ends, np.searchsorted(all_starts, off)

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text with the end id, and n + 1 offsets."""
        data, starts, ends, poff = self.cut(*ta.bytes_of(texts))
        which, unique = pd.factorize(ta.fingerprints(data, starts, ends))
        first = np.zeros(len(unique), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.known) > self.keep:
            self.forget()
        there = np.isin(unique, self.known, assume_unique=True)
        fresh = first[~there]
        raw = data.tobytes()
        got = self._pieces([raw[s:e].decode() for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist())])
        size = np.array([len(g) for g in got], np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.int32)])
        known = np.concatenate([self.known, unique[~there]])
        order = np.argsort(known)
        self.known, self.at = known[order], np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]
        place = np.searchsorted(self.known, unique)
        counts = self.size[place][which]
        flat = ta.take_ranges(self.ids, self.at[place][which], counts)
        doc_off = np.concatenate([[0], np.cumsum(counts)])[poff]
        return np.insert(flat, doc_off[1:], end), doc_off + np.arange(len(doc_off))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _width(symbols: int) -> int:
    """Bytes per symbol."""
    return 2 if symbols <= 1 << 16 else 4


def _apart(rank: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Places taken highest rank first, none next to another; ``near`` says which follow each other."""
    place, taken = np.arange(len(rank)), []
    while len(place):
        r = rank[place]
        by = near[place[:-1]] & (np.diff(place) == 1)
        win = np.ones(len(place), bool)
        win[1:] &= ~(by & (r[:-1] > r[1:]))
        win[:-1] &= ~(by & (r[:-1] < r[1:]))
        gone = win.copy()
        gone[1:] |= win[:-1] & by
        gone[:-1] |= win[1:] & by
        taken.append(place[win])
        place = place[~gone]
    return np.sort(np.concatenate(taken)) if taken else place


class _Sequence:
    """A block's symbols, linked within their documents; replaced symbols are -1."""

    def __init__(self, ids: np.ndarray, off: np.ndarray):
        n = self.n = len(ids)
        self.off = off
        self.sym = np.append(ids.astype(np.int32), np.int32(-1))
        self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        self.after[off[1:] - 1] = self.before[off[:-1]] = n

    def pairs(self) -> np.ndarray:
        """Where pairs start, after closing the gaps."""
        left = np.flatnonzero(self.sym[:-1] >= 0)
        if len(left) < self.n:
            ends = self.after[left] == self.n
            self.off = np.searchsorted(left, self.off)
            n = self.n = len(left)
            self.sym = np.append(self.sym[left], np.int32(-1))
            self.after, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
            self.after[:-1][ends] = self.before[:-1][np.concatenate([[True], ends[:-1]])] = n
        return np.flatnonzero(self.after[:-1] < self.n).astype(np.int32)

    def repeated(self, live: np.ndarray, fresh: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``live`` and pair codes, without most places whose pair is there less than ``least`` times."""
        a, b = self.sym[live], self.sym[self.after[live]]
        bits = min(max((8 * len(live) // least).bit_length(), 8), 24)
        slot = a.view(np.uint32) * np.uint32(0x9E3779B1)
        slot ^= slot >> np.uint32(15)
        slot += b.view(np.uint32)
        slot *= np.uint32(0x85EBCA6B)
        slot >>= np.uint32(32 - bits)
        keep = np.flatnonzero((np.bincount(slot.view(np.int32), minlength=1 << bits) >= least)[slot])
        return live[keep], a[keep].astype(np.int64) * fresh + b[keep]

    def round(self, live: np.ndarray, fresh: int, least: int, room: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace pairs among the places ``live`` that are hit ``least`` times, at most ``room`` of them.

        Returns the places to count next time (no other pair can be frequent) and the new rules.
        """
        live, code = self.repeated(live, fresh, least)
        near = self.after[live[:-1]] == live[1:]
        # in a run of one symbol every second place counts, from the left
        same = self.sym[live] == self.sym[self.after[live]]
        first = same.copy()
        if same.any():
            inner = np.zeros(len(live), bool)
            inner[1:] = same[1:] & same[:-1] & near
            at = np.arange(len(live))
            first &= (at - np.maximum.accumulate(np.where(inner, 0, at))) % 2 == 0
        order = np.sort(code[~same | first])
        starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, int)
        times = np.diff(np.append(starts, len(order)))
        pairs, times = order[starts][times >= least], times[times >= least]
        if not len(pairs):
            return live[:0], np.zeros((0, 2), np.int32)
        pair = np.searchsorted(pairs, code)
        pair[pair == len(pairs)] = 0
        often = pairs[pair] == code
        live, pair, first = live[often], pair[often], first[often]
        near = self.after[live[:-1]] == live[1:]
        # the most frequent first, ties mixed
        mixed = pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        by = np.lexsort((mixed, times))
        rank = np.empty(len(pairs), np.int32)
        rank[by] = np.arange(len(pairs), dtype=np.int32)
        rank_at = 2 * rank[pair] + first
        hit = _apart(rank_at, near)
        good = np.bincount(pair[hit], minlength=len(pairs)) >= least
        chosen = by[::-1][good[by[::-1]]][:room]
        good[:] = False
        good[chosen] = True
        if len(chosen) < len(pairs):                          # what rejected pairs had taken is free again
            hit = hit[good[pair[hit]]]
            free = good[pair]
            free[hit] = False
            free[hit[hit + 1 < len(live)] + 1] &= ~near[hit[hit + 1 < len(live)]]
            free[hit[hit > 0] - 1] &= ~near[hit[hit > 0] - 1]
            more = np.flatnonzero(free)
            if len(more):
                hit = np.concatenate([hit, more[_apart(rank_at[more], (self.after[live[more[:-1]]] == live[more[1:]]))]])
        number = np.zeros(len(pairs), np.int32)
        number[chosen] = fresh + np.arange(len(chosen), dtype=np.int32)
        at, to = live[hit], number[pair[hit]]
        gone = self.after[at]
        self.sym[at], self.sym[gone] = to, -1
        self.after[at] = self.after[gone]
        self.before[self.after[at]] = at
        look = np.zeros(self.n + 1, bool)
        look[live[~good[pair]]] = look[at] = look[self.before[at]] = True
        look = np.flatnonzero(look[:-1])
        rules = np.stack([pairs[chosen] // fresh, pairs[chosen] % fresh], 1).astype(np.int32)
        return look[(self.sym[look] >= 0) & (self.after[look] < self.n)], rules

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        left = self.sym[:-1] >= 0
        return self.sym[:-1][left], np.concatenate([[0], np.cumsum(left)])[self.off]


def compress(ids: np.ndarray, off: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: the symbols, their n + 1 document offsets and the (rules, 2) pairs."""
    seq, rules, n_rules = _Sequence(ids, off), [np.zeros((0, 2), np.int32)], 0
    short = None
    while True:
        width = 4 if short else _width(base)
        pays = least = RULE_BYTES // width + 1
        while 8 * least <= seq.n >> 9:
            least *= 8
        live = seq.pairs()
        while room := (1 << 16) - base - n_rules if width == 2 else 1 << 30:
            live, new = seq.round(live, base + n_rules, least, room)
            rules.append(new)
            n_rules += len(new)
            if not len(new):
                if least == pays:
                    break
                least, live = least // 8, seq.pairs()
        if room:
            break
        # two bytes are used up: go on with four, unless the places left cannot make up for it
        short = (*seq.result(), n_rules)
        n, more = len(short[0]), len(seq.repeated(seq.pairs(), base + n_rules, RULE_BYTES // 4 + 1)[0])
        if 4 * (n - more) >= 2 * n:
            break
    sym, soff = seq.result()
    if short and RULE_BYTES * n_rules + 4 * len(sym) >= RULE_BYTES * short[2] + 2 * len(short[0]):
        sym, soff, n_rules = short
    return sym, soff, np.concatenate(rules)[:n_rules]


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.tolist():                           # rules only use earlier ones
        lengths.append((lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1))
    return np.array(lengths, np.int64)


def expand(sym: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids behind grammar symbols, all nonterminals a level at a time."""
    lengths = expansion_lengths(rules, base) if lengths is None else lengths
    size = np.ones(len(sym), np.int64)
    inner = sym >= base
    size[inner] = lengths[sym[inner] - base]
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), sym.dtype)
    while True:
        out[at[~inner]] = sym[~inner]
        if not inner.any():
            return out
        at, pairs = at[inner], rules[sym[inner] - base]
        left = np.ones(len(at), np.int64)
        deep = pairs[:, 0] >= base
        left[deep] = lengths[pairs[deep, 0] - base]
        sym, at = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([at, at + left])
        inner = sym >= base


def read_range(block, doc: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi of the block's document number ``doc``, expanding only the symbols there."""
    sym, off, rules, lengths = _unpack(block)
    part = sym[off[doc]:off[doc + 1]]
    size = np.where(part >= block["base"], lengths[np.maximum(part - block["base"], 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
    skip = lo - (ends[a] - size[a]) if a < len(ends) else 0
    return expand(part[a:b], rules, block["base"], lengths)[skip:skip + max(hi - lo, 0)]


def _unpack(block):
    sym = np.frombuffer(block["symbols"], "<u2" if block["width"] == 2 else "<u4").astype(np.int32)
    off = np.concatenate([[0], np.cumsum(np.array(block["doc_symbols"], np.int64))])
    rules = np.frombuffer(block["rules"], "<u4").astype(np.int32).reshape(-1, 2)
    return sym, off, rules, np.frombuffer(block["lengths"], "<u4").astype(np.int64)


def _writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(path)
        base = enc.base
        for k, b in enumerate(ta.text_batches(batches, max_bytes=BLOCK_BYTES)):
            ids, off = enc.encode(b.column("text"), end)
            sym, soff, rules = compress(ids, off, base)
            width = _width(base + len(rules))
            row = {"shard": shard, "block": k, "n_tokens": len(ids), "base": base, "width": width,
                   "doc_ids": b.column("doc_id").to_pylist(), "doc_symbols": np.diff(soff).astype(np.int32),
                   "rules": rules.astype("<u4").tobytes(),
                   "lengths": expansion_lengths(rules, base).astype("<u4").tobytes(),
                   "symbols": sym.astype("<u2" if width == 2 else "<u4").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)
    return run


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("base", pa.int32()),
                    ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int32())),
                    ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Encode every text and write the block files of ``folder``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = ["doc_id", "h"]
    ranged = (rows.withColumn("h", F.xxhash64("text")).repartitionByRange(*order)
              .sortWithinPartitions(*order).select("doc_id", "text"))
    ranged.mapInArrow(_writer(path, end), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            block = {c: b.column(c)[i].as_py() for c in ("shard", "block", "base", "width", "doc_ids", "doc_symbols",
                                                         "rules", "lengths", "symbols")}
            sym, off, rules, lengths = _unpack(block)
            size = np.ones(len(sym), np.int64)
            inner = sym >= block["base"]
            size[inner] = lengths[sym[inner] - block["base"]]
            at = np.concatenate([[0], np.cumsum(size)])[off]
            raw = expand(sym, rules, block["base"], lengths).astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(at.tolist(), at[1:].tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block["shard"], np.int32)), pa.array(np.full(n, block["block"], np.int32)),
                 pa.array(block["doc_ids"], pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)),
                 pa.array(crc, pa.int64())],
                names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the block files."""
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)         # one row a shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("block_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
              .join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("at")))
    decoded = blocks.drop("n_tokens").mapInArrow(
        _reader, "shard int, block int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    n_blocks = blocks.select("shard").count()
    return (decoded.join(small(starts, n_blocks), ["shard", "block"])
            .select("doc_id", (F.col("at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"))


def store(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write the block files below the shared checkpoint folder and read them back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-blocks")
    write(docs, path, folder, end)
    return read(spark.read.schema(BLOCK_SCHEMA).parquet(folder))
