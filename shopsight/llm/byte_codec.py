"""Byte-level BPE encoding and decoding over a shared trie (operator 12).

A text is split at the tokenizer's added tokens and then by its pattern into words.  The
distinct new words of a batch of texts are a trie of their UTF-8 bytes: in byte order each
word enters it at the node where it leaves the word before, and the walk goes depth first
with the states of the path from the root on a stack.  The state of a node is the last token
of the encoding of its prefix and where that token begins, so a prefix that several words
share is encoded once and a word's ids are read by following the beginnings back from its
node.  Encoded words are kept for the next batches of the Python worker, ``WORDS`` at most.

The last token of a prefix is the one vocabulary entry that ends there and fits behind the
last token of what stands before it.  Two tokens fit when no merge crosses their border while
they are built: ``x`` on the right edge of the first (alive until its merge of rank ``cx``)
and ``y`` on the left edge of the second (until ``cy``) would merge at rank ``r`` when
``r < cx`` and ``r <= cy`` (equal pairs merge from the left).  Encodings whose neighbours all
fit are exactly those of the merge procedure, provided that merges only use earlier tokens;
``Codec`` checks this of the file and refuses tokenizers of another kind.

Code points without a class in Python's tables
are split by the library's own pattern.  Texts over ``SLICE`` characters are read in slices
that begin at a blank after another character, where the pattern always cuts.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows
are encoded each; ids outside the vocabulary are skipped in decoding, as the library does;
only ``doc_id`` and ``text`` (``ids``) are read, whatever other columns there are; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shopsight.llm import textarrays as ta

WORDS = 200_000          # encoded words, and checked pairs of tokens, that a Python worker keeps
SLICE = 1 << 20          # characters split at once
NEVER = 1 << 30          # rank of a merge that does not come
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


Word = tuple[array, str, bytes]          # ids, the ids in decimal, the bytes they stand for


_NEW = regex.compile(r"\p{Cn}")


def unassigned(text: str) -> bool:
    """Whether a code point is unknown to the tables of the pattern or of Python."""
    there = set(text)
    return bool(_NEW.search("".join(there))) or any(unicodedata.category(c) == "Cn" for c in there)


class Codec:
    """Vocabulary, merges and the trie of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # one thread a task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                 "byte_fallback": False, "ignore_merges": False}
        odd = [k for k, v in plain.items() if (model.get(k) or v) != v]
        if odd or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take blanks or whole words")
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(PATTERN)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.marks = regex.compile("(" + "|".join(regex.escape(t) for t in added) + ")") if added else None
        to_byte = byte_alphabet()
        size = max([*model["vocab"].values(), *added.values()]) + 1
        self.surface: list[bytes] = [b""] * size
        self.token: dict[bytes, int] = {}
        for text, i in model["vocab"].items():
            self.surface[i] = bytes(to_byte[c] for c in text)
            self.token[self.surface[i]] = i
        for text, i in added.items():
            self.surface[i] = text.encode()
        self.size = size
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, t = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            late = [x for x in (a, b) if len(self.surface[x]) > 1 and x not in self.made]
            if late or t in self.made:
                raise ValueError(f"{path}: merge {r} uses a later token or makes one again")
            self.rank[a * size + b] = r
            self.made[t] = (a, b, r)
        self.reach = [1] * (1 << 16)                         # longest token by its last two bytes
        for s in self.token:
            if len(s) > 1:
                k = s[-2] << 8 | s[-1]
                self.reach[k] = max(self.reach[k], len(s))
        self.right_edge = functools.cache(functools.partial(self._edge, 1))
        self.left_edge = functools.cache(functools.partial(self._edge, 0))
        self.whole = functools.cache(self._whole)
        self.usable = {s: t for s, t in self.token.items() if self.whole(t)}
        self.fit: dict[int, bool] = {}
        self.known: dict[str, Word] = {}

    def _edge(self, side: int, t: int) -> tuple[tuple[int, int], ...]:
        """Tokens along one edge below ``t`` with the rank of the merge that ends each."""
        out, end = [], NEVER
        while t is not None:
            out.append((t, end))
            made = self.made.get(t)
            t, end = (made[side], made[2]) if made else (None, NEVER)
        return tuple(out)

    def _apart(self, first: int, second: int, end: int) -> bool:
        """No merge before rank ``end`` crosses the border of two tokens."""
        for x, cx in self.right_edge(first):
            cx = min(cx, end)
            for y, cy in self.left_edge(second):
                r = self.rank.get(x * self.size + y)
                if r is not None and r < cx and r <= cy and r < end:
                    return False
        return True

    def _whole(self, t: int) -> bool:
        """The token's own bytes encode to the token."""
        if t not in self.made:
            return len(self.surface[t]) == 1
        a, b, r = self.made[t]
        return self.whole(a) and self.whole(b) and self._apart(a, b, r)

    def fits(self, key: int) -> bool:
        """Whether the second token of a pair may follow the first; ``key`` is first * size + second."""
        if len(self.fit) >= WORDS:
            self.fit.clear()
        known = self.fit[key] = self._apart(*divmod(key, self.size), NEVER)
        return known

    def _trie(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of distinct words in byte order, by one depth-first walk over their trie.

        ``last[k]`` and ``begin[k]`` are the state of the node k bytes below the root on the
        path to the present word; going on to the next word, the path is cut back to where
        both part."""
        last, begin = array("i", [-1]), array("q", [0])
        usable, fit, reach, size, before = self.usable, self.fit, self.reach, self.size, b""
        for word in words:
            length = len(word)
            end = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                end += 1
            del last[end + 1:], begin[end + 1:]
            while end < length:
                end += 1
                at = max(0, end - reach[word[end - 2] << 8 | word[end - 1]]) if end > 1 else 0
                while True:
                    t = usable.get(word[at:end])
                    if t is not None:
                        if not at:
                            break
                        key = last[at] * size + t
                        ok = fit.get(key)
                        if ok if ok is not None else self.fits(key):
                            break
                    at += 1
                last.append(t)
                begin.append(at)
            ids, at = [], length
            while at:
                ids.append(last[at])
                at = begin[at]
            yield ids[::-1]
            before = word

    def _slices(self, text: str) -> Iterator[str]:
        lo = 0
        while len(text) - lo > SLICE:
            hi = lo + SLICE
            while (hi := text.find(" ", hi)) >= 0 and (text[hi - 1].isspace()):
                hi += 1
            if hi < 0:
                break
            yield text[lo:hi]
            lo = hi
        yield text[lo:]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, in lists; an added token is a list of its own."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield [part]
                continue
            for piece in self._slices(part):
                if piece.isascii() or not unassigned(piece):
                    yield self.pattern.findall(piece)
                else:
                    spans = self.library.pre_tokenizer.pre_tokenize_str(piece)
                    yield [piece[a:b] for _, (a, b) in spans]

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are new."""
        if len(self.known) > WORDS:
            self.known.clear()
        for t, i in self.added.items():
            self.known[t] = self._word([i])
        fresh = {w.encode(): w for w in set(words) if w not in self.known}
        order = sorted(fresh)
        for raw, ids in zip(order, self._trie(order)):
            self.known[fresh[raw]] = self._word(ids)

    def _word(self, ids: list[int]) -> Word:
        return array("i", ids), ",".join([str(i) for i in ids]), b"".join([self.surface[i] for i in ids])

    def encode(self, text: str | None) -> Iterator[list[Word]]:
        """The encoded words of a text, a list for every slice of it."""
        for words in self.words(text or ""):
            missing = [w for w in words if w not in self.known]
            if missing:
                self.learn(words)
            known = self.known
            yield [known[w] for w in words]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.surface[i] for i in ids if 0 <= i < self.size]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _texts(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[tuple[pa.RecordBatch, Iterator[list[Word]]]]:
    """Batches and for every text its encoded words, slice by slice; the words of a batch are
    learnt together, but for texts that are read in slices."""
    for b in ta.text_batches(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        split = [list(c.words(t)) if len(t) <= SLICE else None for t in texts]
        c.learn(w for parts in split for words in parts or () for w in words)
        yield b, (c.encode(t) if parts is None else ([c.known[w] for w in words] for words in parts)
                  for t, parts in zip(texts, split))


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b, texts in _texts(batches, c):
            ids = [[i for part in t for word in part for i in word[0]] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])
    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode([i for i in ids or () if i is not None]) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return run


def _digest(parts: Iterator[list[Word]]) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the text that they decode to."""
    n, sha, raw = 0, hashlib.sha256(), []
    for part in filter(None, parts):
        sha.update((("," if n else "") + ",".join([w[1] for w in part])).encode())
        raw.append(b"".join([w[2] for w in part]))
        n += sum([len(w[0]) for w in part])
    decoded = b"".join(raw).decode("utf-8", "replace")
    return n, sha.hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _digester(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b, texts in _texts(batches, c):
            rows = [_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[k] for r in rows], kind)
                                       for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every text."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(path), f"doc_id {_id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), f"doc_id {_id_type(encoded)}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, decode its ids, and
    keep only digests of both."""
    return docs.select("doc_id", "text").mapInArrow(
        _digester(path), f"doc_id {_id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
