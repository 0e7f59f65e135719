"""Substring dedup by recompression (operator 6).

Recompression: in rounds, runs of one symbol become a symbol named by (symbol, length),
then adjacent pairs (a symbol of the round's left half, one of its right half) become a
symbol named by the two.  Names are fingerprints of what they stand for, so they are the
same in every document without a dictionary, and equal substrings get equal interior
symbols: what a round does to a symbol depends on its neighbours only.  Every window keeps
the range of symbols that its own words determine (a round costs it the first and last run,
and a symbol that could pair outwards); the first symbol of the highest level where that
range is not empty is the window's name.  Equal windows have equal names at equal offsets.

1. Blocks of documents list the distinct names of their windows; names are dealt over slots
   by hash, and a slot answers every block with one bit per name: does it occur twice?
2. Windows whose name is shared send their whole fingerprint the same way.  64 bits are
   compared within a slot that a second, independent fingerprint chose.
3. Words of windows that occur twice are removed.

Questions and answers are packed arrays, one row per block and slot, so hot passages cost a
block one entry however often they occur, and no slot holds more than its share of names.
Blocks are written once and never shuffled: the answers come to them by broadcast, in passes
over runs of blocks whose answers are together proven small enough.  A pass reads only the
files of its run, so any size is one reading of the texts a step.

Defined cases: null and empty texts have no words and the digest of the empty text; texts
of fewer than ``size`` words keep all; rows without doc_id take part like all others;
repeated rows make each other's windows repeat; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm import textarrays as ta
from shopsight.llm.common import staged
from shopsight.session import scratch_path

SIZE = 35
BLOCK_BYTES = 4 << 20             # of text
ROUNDS = 16                       # a round shortens every window; none of 35 words lasts so long
MIN_SLOTS = 64
BROADCAST_BYTES = 32 << 20        # answers of the blocks of one pass together, at most
PACK = 6                          # passes are cut between packs of 2 ** PACK blocks of one task
NAME_BYTES = 6                    # of a name: a clash only makes a window a candidate
# Parquet checks sizes after 100 rows by default: all blocks of a task would be one page, and
# a reader would hold them all; so every block is a page, and a row group ends after its size.
BLOCK_FILES = {"compression": "zstd", "parquet.block.size": str(BLOCK_BYTES), "parquet.page.size.row.check.min": "1"}


def window_names(h: np.ndarray, doc: np.ndarray, woff: np.ndarray, size: int = SIZE):
    """Starts of all windows, the name of each, and where its symbol starts."""
    n = len(h)
    p = np.arange(max(n - size + 1, 0))
    p = p[p + size <= woff[doc[p] + 1]] if len(p) else p
    name, at = ta.mix(h[p]), p.copy()
    live, left, right = np.arange(len(p)), p, p + size              # right is exclusive
    sym, sdoc, start = h, doc, np.arange(n)
    half = np.arange(ROUNDS + 1, dtype=ta.U) * ta.U(0xD6E8FEB86659FD93)      # a new split every round
    for level in range(1, ROUNDS + 1):
        if not len(live):
            break
        fresh = np.ones(len(sym), bool)
        fresh[1:] = (sym[1:] != sym[:-1]) | (sdoc[1:] != sdoc[:-1])
        run_at = np.flatnonzero(fresh)
        run_of = np.cumsum(fresh) - 1
        length = np.diff(np.append(run_at, len(sym)))
        run = np.where(length > 1, ta.mix(sym[run_at] + length.astype(ta.U) * ta.U(0x9E3779B97F4A7C15)), sym[run_at])
        rdoc = sdoc[run_at]
        is_right = (ta.mix(run + half[level]) >> ta.U(63)).astype(bool)
        second = np.zeros(len(run), bool)
        second[1:] = is_right[1:] & ~is_right[:-1] & (rdoc[1:] == rdoc[:-1])
        lo, hi = run_of[left] + 1, run_of[right - 1]
        keep = lo < hi
        lo, hi, live = lo[keep], hi[keep], live[keep]
        lo = lo + is_right[lo]
        hi = hi - ~is_right[hi - 1]
        keep = lo < hi
        lo, hi, live = lo[keep], hi[keep], live[keep]
        head = np.flatnonzero(~second)
        group = np.cumsum(~second) - 1
        paired = np.append(second, False)[head + 1]
        new = run[head]
        mate = head[paired] + 1
        new[paired] = ta.mix(new[paired] * ta.U(0xA0761D6478BD642F) + run[mate])
        left, right = group[lo], group[hi - 1] + 1
        sym, sdoc, start = new, rdoc[head], start[run_at][head]
        name[live] = ta.mix(sym[left] + ta.U(level))
        at[live] = start[left]
    return p, name, at


def _questions(values: np.ndarray, slot: np.ndarray, twice: np.ndarray, width: int, block: int):
    """One row per slot: the block's values there (in order) and whether it has them twice."""
    order = np.argsort(slot, kind="stable")
    cuts = np.flatnonzero(np.diff(slot[order])) + 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[order, :width]
    flags = twice[order]
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if hi > lo:
            yield {"block": block, "slot": int(slot[order[lo]]), "n": hi - lo, "names": raw[lo:hi].tobytes(),
                   "twice": np.packbits(flags[lo:hi]).tobytes()}


_Q = pa.schema([("block", pa.int64()), ("slot", pa.int64()), ("n", pa.int64()), ("names", pa.binary()),
                ("twice", pa.binary())])
_Q_DDL = "block bigint, slot bigint, n bigint, names binary, twice binary"


def _answer(width: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        raw = np.frombuffer(b"".join(r["names"] for r in rows), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        _, inverse, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        sizes = np.array([r["n"] for r in rows])
        twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]) for r in rows])
        shared = times > 1
        shared[inverse[twice > 0]] = True
        flags = np.split(shared[inverse], np.cumsum(sizes)[:-1])
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()),
                         "slot": pa.array([r["slot"] for r in rows], pa.int64()),
                         "mask": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})
    return run


def _flags(mask: bytes | None, slot: np.ndarray) -> np.ndarray:
    """The answers, back in the order of the values that were asked about: slot by slot in
    whole bytes, each slot's values in their order."""
    order = np.argsort(slot, kind="stable")
    counts = np.unique(slot, return_counts=True)[1]
    width = -(-counts // 8)
    bits = np.unpackbits(np.frombuffer(mask or b"", np.uint8)).astype(bool)
    out = np.zeros(len(slot), bool)
    out[order] = bits[np.repeat(8 * (np.cumsum(width) - width), counts) + ta.spread_counts(counts)]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for k, b in enumerate(ta.text_batches(batches, max_bytes=BLOCK_BYTES)):
        data, off = ta.bytes_of(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + k], pa.int64()),
             pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id")),
             pa.array([off.astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
            names=["block", "doc_ids", "off", "data"])


_BLOCK_DDL = "block bigint, doc_ids array<bigint>, off binary, data binary"


def _each(batches: Iterator[pa.RecordBatch], columns=()):
    """The block rows one at a time: id, ids of the documents, bytes, offsets, extra columns."""
    for b in batches:
        for i in range(b.num_rows):
            yield (b.column("block")[i].as_py(), b.column("doc_ids")[i].values if "doc_ids" in b.schema.names else None,
                   np.frombuffer(b.column("data")[i].as_buffer(), np.uint8),
                   np.frombuffer(b.column("off")[i].as_buffer(), "<i8"), *[b.column(c)[i].as_py() for c in columns])


def _named(data: np.ndarray, off: np.ndarray, size: int, slots: int):
    starts, ends, woff = ta.words(data, off)
    h = ta.fingerprints(data, starts, ends)
    p, name, at = window_names(h, ta.owner(woff), woff, size)
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1])        # windows in a row share a symbol
    unique, times = np.unique(name[new], return_counts=True)
    return h, p, name, unique, (unique >> ta.U(40)).astype(np.int64) % slots, times > 1


def _ask_names(size: int, slots: int):
    def run(batches):
        for block, _, data, off in _each(batches):
            *_, unique, slot, twice = _named(data, off, size, slots)
            rows = list(_questions(unique, slot, twice, NAME_BYTES, block))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_Q)
    return run


def _candidates(h: np.ndarray, p: np.ndarray, size: int, slots: int):
    """Whole fingerprints of the windows p, distinct: values, slots, index of each window."""
    one = ta.windows(h, size)[p]
    two = ta.windows(ta.mix(h ^ ta.U(0x2545F4914F6CDD1D)), size)[p]
    slot = (two >> ta.U(16)).astype(np.int64) % slots
    keyed = ta.mix(one + slot.astype(ta.U) * ta.U(0x9E3779B97F4A7C15))
    _, first, which, times = np.unique(keyed, return_index=True, return_inverse=True, return_counts=True)
    return one[first], slot[first], which, times > 1


def _ask_windows(size: int, slots: int):
    def run(batches):
        for block, _, data, off, mask in _each(batches, ("mask",)):
            h, p, name, unique, slot, _ = _named(data, off, size, slots)
            shared = _flags(mask, slot)
            maybe = shared[np.searchsorted(unique, name)]
            values, wslot, _, twice = _candidates(h, p[maybe], size, slots)
            rows = list(_questions(values, wslot, twice, 8, block))
            rows.append({"block": block, "slot": -1, "n": len(p), "names": np.packbits(maybe).tobytes(), "twice": b""})
            yield pa.RecordBatch.from_pylist(rows, schema=_Q)
    return run


def _remove(size: int, slots: int):
    """(doc_id, n_words, n_removed, kept) with the kept words joined by a blank."""
    def run(batches):
        for _, ids, data, off, mask, maybe in _each(batches, ("mask", "maybe")):
            starts, ends, woff = ta.words(data, off)
            h = ta.fingerprints(data, starts, ends)
            doc = ta.owner(woff)
            p = np.arange(max(len(h) - size + 1, 0))
            p = p[p + size <= woff[doc[p] + 1]] if len(p) else p
            p = p[np.unpackbits(np.frombuffer(maybe or b"", np.uint8), count=len(p)).astype(bool)] if len(p) else p
            _, wslot, which, _ = _candidates(h, p, size, slots)
            gone = ta.covered(p[_flags(mask, wslot)[which]], size, len(h))
            yield ids, woff, gone, data, starts, ends
    return run


def _kept_texts(data, starts, ends, woff, gone):
    """Kept words of every document joined by a blank, as bytes."""
    keep = ~gone
    lens = (ends - starts)[keep] + 1
    place = np.cumsum(lens) - lens
    out = np.full(int(lens.sum()), 0x20, np.uint8)
    body = lens - 1
    out[np.repeat(place, body) + ta.spread_counts(body)] = ta.take_ranges(data, starts[keep], body)
    before = np.concatenate([[0], np.cumsum(keep)])[woff]
    edge = np.append(place, len(out))
    raw = out.tobytes()
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
        yield raw[edge[lo]:edge[hi] - 1] if hi > lo else b""


def _reported(size: int, slots: int, texts: bool):
    inner = _remove(size, slots)

    def run(batches):
        for ids, woff, gone, data, starts, ends in inner(batches):
            n = len(woff) - 1
            kept = _kept_texts(data, starts, ends, woff, gone)
            last = [t.decode() for t in kept] if texts else [hashlib.sha256(t).hexdigest() for t in kept]
            removed = np.bincount(ta.owner(woff)[gone], minlength=n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(woff)), pa.array(removed), pa.array(last)],
                                             names=["doc_id", "n_words", "n_removed", "text" if texts else "kept_sha256"])
    return run


def _answers(asked: DataFrame, width: int, maybe: DataFrame | None = None) -> DataFrame:
    """(block, mask, maybe): all slots' answers to a block, one bit per value, and its own
    bits of ``maybe``; ordered by block, so that a pass skips the files of the others."""
    got = asked.groupBy("slot").applyInArrow(_answer(width), "block bigint, slot bigint, mask binary")
    if maybe is not None:
        got = got.unionByName(maybe)
    each = got.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "mask"))).alias("m"))
    each = each.select("block", F.expr("unhex(array_join(transform(filter(m, x -> x.slot >= 0), x -> hex(x.mask)), ''))")
                       .alias("mask"), F.expr("get(filter(m, x -> x.slot < 0), 0).mask").alias("maybe"))
    return staged(each.repartitionByRange("block").sortWithinPartitions("block"), "answers")


def _files(blocks: DataFrame) -> list:
    """Name, first and last block and number of blocks of every file."""
    return blocks.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("block").alias("lo"), F.max("block").alias("hi"), F.count("*").alias("n")).collect()


def _passes(blocks: DataFrame, path: str, files: list, answers: DataFrame) -> list[DataFrame]:
    """Every block beside its answers, in runs of blocks whose answers are at most
    BROADCAST_BYTES together (a pack at least); the texts stay where they are."""
    size = F.octet_length("mask") + F.coalesce(F.octet_length("maybe"), F.lit(0)) + 64
    packs = (answers.groupBy(F.shiftright("block", PACK).alias("pack")).agg(F.sum(size).alias("bytes"))
             .orderBy("pack").collect())
    cuts, total = [0], 0
    for r in packs:
        if total and total + r["bytes"] > BROADCAST_BYTES:
            cuts.append(r["pack"] << PACK)
            total = 0
        total += r["bytes"]
    if len(cuts) == 1:
        return [blocks.join(F.broadcast(answers), "block", "left")]
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], 1 << 62]):
        own = [f"{path}/{f['file']}" for f in files if f["hi"] >= lo and f["lo"] < hi]
        run = F.col("block").between(lo, hi - 1)
        here = blocks.sparkSession.read.schema(blocks.schema).parquet(*own).filter(run)
        out.append(here.join(F.broadcast(answers.filter(run)), "block", "left"))
    return out


def _written(frames: list[DataFrame], name: str) -> DataFrame:
    """The frames one after the other in one staged table."""
    spark = frames[0].sparkSession
    path = scratch_path(spark, name)
    for df in frames:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path)


def _run(docs: DataFrame, size: int, texts: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path = scratch_path(docs.sparkSession, "text-blocks")
    rows.mapInArrow(_blocks, _BLOCK_DDL).write.options(**BLOCK_FILES).parquet(path)
    blocks = docs.sparkSession.read.schema(_BLOCK_DDL).parquet(path)
    bare = blocks.select("block", "off", "data")
    files = _files(blocks)
    slots = max(MIN_SLOTS, sum(f["n"] for f in files) // 4)
    named = _answers(bare.mapInArrow(_ask_names(size, slots), _Q_DDL), NAME_BYTES)
    windows = _written([df.mapInArrow(_ask_windows(size, slots), _Q_DDL)
                        for df in _passes(bare, path, files, named)], "window-questions")
    maybe = windows.filter("slot < 0").select("block", "slot", F.col("names").alias("mask"))
    twice = _answers(windows.filter("slot >= 0"), 8, maybe)
    out = "doc_id bigint, n_words bigint, n_removed bigint, " + ("text string" if texts else "kept_sha256 string")
    last = [df.mapInArrow(_reported(size, slots, texts), out) for df in _passes(blocks, path, files, twice)]
    return last[0] if len(last) == 1 else _written(last, "reported")


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return _run(docs, size, texts=False)


def deduplicate(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined by single blanks."""
    return _run(docs, size, texts=True)
