"""Small tables and plain Python forms of the training-data operators."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     StructField("n_chars", LongType()),
                     # names that operators use inside
                     StructField("kept", StringType()), StructField("size", IntegerType()),
                     StructField("key", StringType()), StructField("score", StringType()),
                     StructField("digest", StringType()), StructField("h", StringType())])


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, "k", "s", "d", "h") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, n, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, edge cases."""
    rng = random.Random(5)
    base = [prose(i, rng.choice([3, 7, 30, 60, 200])) for i in range(40)]
    rows = [(i, t, f"src{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5], "src0") for i in range(20)]                       # a hot group of copies
    for i in range(20):                                                             # near copies of one text
        w = base[39].split() if len(base[39].split()) > 50 else prose(99, 200).split()
        w[(i * 7) % len(w)] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "src1"))
    shared = prose(777, 60)
    rows += [(300 + i, f"{prose(400 + i, 25)} {shared} {prose(500 + i, 25)}", "src2") for i in range(6)]
    rows += [(400, None, None), (401, "", "src0"), (402, " \n\t ", "src3"), (403, "one", None), (404, "One", "src1"),
             (405, "a b c d", "src1"), (406, "A  b\nc d", "src1"), (407, "x " * 90, "src2"), (408, "y" * 3000, "src2"),
             (409, prose(1, 3000), "src3"), (410, "日本語 テキスト é é　x\xa0y ▁z 𐍈", "src3"), (None, "no id at all", "src3")]
    return rows


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_classes(rows):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def mix_plan(rows, weights=(5, 2, 1), times=3, seed="mix-1"):
    """[(doc_id, size, source_size, target, taken)] by loops; the excess is shared out again and again."""
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r[2]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(size))
    while open_ and left > 1e-9:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if target[s] + share * w[s] > times * total[s]}
        if not over:
            for s in open_:
                target[s] += share * w[s]
            break
        for s in over:
            left -= times * total[s] - target[s]
            target[s] = float(times * total[s])
        open_ -= over
    out = []
    for s in order:
        mine = []
        for i, r in enumerate(rows):
            if r[2] == s:
                u = (int(md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                marks = sum(c in "#*$%&|<>" for c in r[1] or "")
                q = max(0.05, 1 - marks / size[i]) if size[i] else 0.05
                mine.append((-math.log(u) / q, -1 if r[0] is None else r[0], size[i], i))
        epochs = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        rest, at = math.floor(target[s] - epochs * total[s] + 1e-6), 0
        for _, _, n, i in sorted(mine):
            out.append((rows[i][0], n, total[s], target[s], epochs * n + max(0, min(n, rest - at))))
            at += n
    return out


def repeats(rows, size=35):
    """{row index: (n_words, kept words)} by listing all windows."""
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out
