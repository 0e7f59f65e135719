"""Secret scans by assignment-aware lexing (operator 3).

Three token shapes are found everywhere: ``assign`` (a sensitive name, ``=`` or ``:``, a
value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs).  On top of them a
lexer reads source and configuration text - assignments in the style of most languages,
JSON, YAML and INI pairs, keyword arguments, command-line flags, XML elements and URL
credentials - into pairs of a name and an expression of literals and other names.
Constants are propagated: an expression's names stand for the literals they were last
given (through any number of names), so ``k = "..."; password = k`` leads to the first
literal.  A literal scores by how sensitive its target name is and how much it looks like
a secret rather than a word, a placeholder or a reference; ``literal`` spans are added
where the score reaches ``THRESHOLD``, which a random-looking literal does under each listed
name.  Under a name that is often something else (``VAGUE``) it must not read as words.

Defined cases: null and empty texts have no spans; a text is scanned whole however long, and
so are values, of any number of literals; triple-quoted and backtick literals and XML values go
over lines; a YAML block scalar gives a literal a line.  Names have lengths: of one longer than 80
characters the last 80 count, a flag's or an element's has up to 61, an index text 60, an annotation 41.
Calls and brackets are read for their literals, but for the first argument of a call that looks
something up; pairs of targets and values are matched by place; setters and calls with a sensitive
text before a literal give pairs, too.  Literals with blanks count from 60 characters on, under a
passphrase always.  A constant built piece by piece is read once however often it is used;
an expression of several such constants reads them each time;
rows without doc_id are scanned; repeated rows each count; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shopsight.llm import textarrays as ta

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
THRESHOLD = 1.0

# Name parts and how sensitive they make a target.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "privatekey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "authkey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.9, "bearer": 0.9, "pin": 1.2, "salt": 0.9, "key": 0.9, "pass": 0.9, "pw": 0.9,
}
VAGUE = {"auth", "pin", "salt", "key", "pass"}    # names of many other things, too: their values must not read as words
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|0+|change_?me|example|sample|test|dummy|none|null|nil|true|false|todo|"
                         r"your[-_ ].*|<.*>|\$\{?.*|%\(.*|\{\{.*|redacted|undefined|string|env)$")

_NAME = r"""(?P<q>["']?)(?P<name>[A-Za-z_$][\w$.-]{0,79}(?:\[["'][\w.-]{1,60}["']\])?)(?P=q)"""
PAIR = re.compile(_NAME + r"""[ \t]*(?::[ \t]*(?P<kind>[A-Za-z_][\w.\[\]]{0,40})[ \t]*(?==))?(?:(?<![=!<>])(?::=|=>|=(?!=)|:(?![:/=]))|\|\|=)[ \t]*""")
OPERAND = re.compile(r'''(?P<open>[rbuf]{0,2}(?:"""|\'\'\'|["'`]))|(?P<call>(?:new[ \t]+)?[A-Za-z_$][\w$.]{0,79}+[ \t]*\()|(?P<item>[A-Za-z_$][\w$.]{0,79}+\[[^\]\n]*+\])|(?P<group>[(\[])|(?P<ref>[A-Za-z_$][\w$.]{0,79})(?![\w$("'`\[]|={1,2}(?![^\s"'`,;)}\]]))|(?P<bare>[^\s"'`,;(){}\[\]<>#]+)''', re.A)
CHAIN = re.compile(r"\.[A-Za-z_$][\w$]{0,79}+\(")
NAMED = re.compile(r"[ \t]*(?:=(?!=)|:(?!:))")             # what was read is a name of an argument or a key
BLANKS = re.compile(r"\s*+")
READERS = re.compile(r"(?i)(?:^|[._ ])(?:get|getenv|env|environ|getproperty|getstring|lookup|fetch|param|parameter|input|getpass)[ \t]*\($")
TARGETS = re.compile(r"[ \t]*(?:[A-Za-z_$][\w$.]*+[ \t]*,[ \t]*)+")   # names before one in a tuple of targets
COMMA = re.compile(r"[ \t]*,[ \t]*")
SETTER = re.compile(r"(?<![A-Za-z])set_?(?P<name>[A-Z_]\w{1,79}+)\((?=\s*[\"'`])")
ENTRY = re.compile(r"""\(\s*(?P<q>["'])(?P<name>[A-Za-z_][\w.-]{1,79})(?P=q)\s*,\s*(?=["'`])""")
JOIN = re.compile(r"[ \t]*(?:\+|\.\.?|&|\|\||\?\?)[ \t]*(?=[\"'`A-Za-z_$rbuf])|[ \t]+(?=[\"'`])")
FLAG = re.compile(r"(?<![\w-])--(?P<name>[A-Za-z][\w-]{0,60})(?:=|[ \t]+)(?P<value>[^\s\"'-][^\s\"']*|\"[^\"\n]*\"|'[^'\n]*')")
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]{0,60})>\s*+(?P<value>[^<>]+)</(?P=name)>")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"']*+:(?P<value>[^\s/@\"']{3,}+)@")
_LITERAL_END = {q: re.compile(r"[^\\%s\n]*+(?:\\.[^\\%s\n]*+)*+" % (q, q)) for q in "\"'"}
_LITERAL_END |= {q: re.compile(r"[^\\%s]*+(?:(?:\\.|%s)[^\\%s]*+)*+" % (q[0], f"{q[0]}(?!{q[1:]})" if q[1:] else "(?!)", q[0]), re.S)
                 for q in ('"""', "'''", "`")}                 # these may go over lines
BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:#[^\n]*)?\r?\n")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> tuple[float, bool]:
    """The largest weight of a part, or of two adjacent parts, of a name; whether only vague parts have one."""
    parts = [p.lower() for p in _SPLIT.findall(name[-120:])]
    listed = [p for p in [*parts, *map("".join, zip(parts, parts[1:]))] if p in SENSITIVE]
    clear = [p for p in listed if p not in VAGUE]
    return max((SENSITIVE[p] for p in clear or listed), default=0.0), not clear


class Value:
    """What a score needs to know of literals joined one after the other, kept up to date as literals
    are added: characters by number, parts of words, first and last characters."""

    HEAD = 64
    # a part of a word starts where one of these ends: an upper run, its last letter before lower ones, others
    PART = re.compile(r"(?<![A-Z])[A-Z]|(?<![A-Za-z])[a-z]|(?<!\d)\d")
    LAST_UPPER = re.compile(r"(?<=[A-Z])[A-Z][a-z]")

    def __init__(self):
        self.n, self.parts, self.head, self.last, self.counts = 0, 0, "", "", Counter()
        self.literals, self.reported, self.start = [], 0, -1

    def copy(self) -> "Value":
        v = Value()
        v.n, v.parts, v.head, v.last, v.counts = self.n, self.parts, self.head, self.last, self.counts.copy()
        return v

    def add(self, piece: str) -> None:
        seen = self.last + piece
        for pattern in (self.PART, self.LAST_UPPER):
            self.parts += sum(m.end() > len(self.last) for m in pattern.finditer(seen))
        self.n += len(piece)
        self.counts.update(piece)
        self.head = (self.head + piece)[:self.HEAD] if len(self.head) < self.HEAD else self.head
        self.last = seen[-2:]

    def extend(self, text: str, found: list[tuple]) -> bool:
        """Add literals (sorted) that follow those there; false, and nothing added, where they do not."""
        if found and found[0][1] <= self.start:
            return False
        for o in found:
            self.add(text[o[1]:o[2]])
            self.literals.append(o)
            self.start = o[1]
        return True

    def placeholder(self) -> bool:
        if self.n <= self.HEAD:
            return bool(PLACEHOLDER.match(self.head))
        if len({c.lower() for c in self.counts}) == 1:
            return self.head[0] in "xX*.0"
        one_line = self.counts["\n"] == (self.last[-1] == "\n")
        return one_line and bool(re.match(r"(?i)your[-_ ]|\$|%\(|\{\{", self.head)
                                 or self.head[0] == "<" and self.last.rstrip("\n")[-1:] == ">")

    def reads_as_words(self) -> bool:
        """Parts as long as words, with vowels; random literals change between cases and digits all the time."""
        letters = sum(n for c, n in self.counts.items() if c.isascii() and c.isalpha())
        digits = sum(n for c, n in self.counts.items() if c.isdecimal())
        vowels = sum(n for c, n in self.counts.items() if c in "aeiouyAEIOUY")
        return letters > 0 and letters + digits >= 3 * self.parts and 5 * vowels >= letters

    def plausibility(self, blanks: bool = False) -> float:
        """0 for words, placeholders and references; about 1 for random-looking literals."""
        n = self.n
        if n < 6 or self.placeholder() or (not blanks and n < 60 and " " in self.counts):
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c)
        kinds = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in self.counts})
        return min(1.5, 0.25 * entropy + 0.2 * kinds)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The three token shapes: (start, end, kind)."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def block_scalar(text: str, name: int, at: int) -> list[tuple]:
    """The lines from ``at`` that lie deeper than a name at ``name``, which only blanks and dashes precede."""
    column = name - (text.rfind("\n", 0, name) + 1)
    if text[name - column:name].strip(" -\"'"):
        return []
    out = []
    while at < len(text):
        end = text.find("\n", at) % (len(text) + 1)
        line = text[at:end]
        body = line.strip()
        if body:
            lo = at + len(line) - len(line.lstrip())
            if lo - at <= column:
                break
            out.append(("lit", lo, lo + len(body)))
        at = end + 1
    return out


def targets_before(text: str, at: int) -> int:
    """How many targets, parted by commas, a line has before the one at ``at`` (in at most 800 characters)."""
    if text[max(at - 2, 0):at].strip(" \t") != ",":
        return 0
    lo = max(at - 800, 0)
    begin = text.rfind("\n", lo, at) + 1
    if begin == 0 and lo > 0:
        return 0
    return text.count(",", begin, at) if TARGETS.fullmatch(text, begin, at) else 0


def expression(text: str, at: int, several: bool) -> list[list[tuple]]:
    """The operands of an expression, through brackets and calls; with ``several``, of each of the
    expressions that commas part.  A first argument that a reading call looks up is not a value."""
    groups, open_, fresh = [[]], [], True           # open_: [first argument looked up, argument number]
    while True:
        if open_:
            at = BLANKS.match(text, at).end()
            if text[at:at + 1] in (")", "]") and text[at:at + 1]:
                open_.pop()
                at, fresh = at + 1, False
            elif not fresh and text[at:at + 1] == ",":
                open_[-1][1] += 1
                at, fresh = at + 1, True
                continue
        if not fresh:
            chained = CHAIN.match(text, at)
            joined = JOIN.match(text, at)
            if chained:
                open_.append([True, 0])
                at, fresh = chained.end(), True
            elif joined:
                at, fresh = joined.end(), True
            elif several and not open_ and (comma := COMMA.match(text, at)):
                groups.append([])
                at, fresh = comma.end(), True
            elif not open_ or text[at:at + 1] not in (")", "]", ",") or not text[at:at + 1]:
                return groups
            continue
        o = OPERAND.match(text, at)
        if not o:
            return groups
        found, at = None, o.end()
        if o["open"]:
            quote = o["open"].lstrip("rbuf")
            body = _LITERAL_END[quote].match(text, at)
            if not text.startswith(quote, body.end()):
                return groups
            found, at = ("lit", at, body.end()), body.end() + len(quote)
        elif o["call"] or o["group"]:
            open_.append([bool(o["call"] and READERS.search(o["call"])), 0])
            continue
        elif o["ref"]:
            found = ("ref", o["ref"], *o.span("ref"))
        elif o["bare"]:
            found = ("lit", *o.span("bare"))
        if (open_ or len(groups) > 1) and (NAMED.match(text, at) or o["bare"] and o["bare"][-1] == "=" and text[at:at + 1] in ("'", '"')):
            return groups if open_ else groups[:-1]
        if found and not any(looked_up and n == 0 for looked_up, n in open_):
            groups[-1].append(found)
        fresh = False


def lex(text: str) -> Iterator[tuple[str, list[tuple]]]:
    """(name, operands): an operand is ("lit", start, end) or ("ref", name, start, end)."""
    for m in PAIR.finditer(text):
        at, operands = m.end(), []
        block = BLOCK.match(text, at)
        if block and m[0].rstrip(" \t").endswith(":"):
            operands = block_scalar(text, m.start(), block.end())
            if operands:
                yield m["name"], operands
            continue
        place = targets_before(text, m.start())
        groups = expression(text, at, several=place > 0)
        operands = groups[place if place < len(groups) else 0]
        if operands:
            yield m["name"], operands
            if m["kind"]:                                         # "if x: name = ..." looks like an annotation
                yield m["kind"], operands
    for pattern in (SETTER, ENTRY):
        for m in pattern.finditer(text):
            operands = expression(text, m.end(), several=False)[0]
            if operands:
                yield m["name"], operands
    for m in FLAG.finditer(text):
        lo, hi = m.span("value")
        quoted = hi - lo > 1 and text[lo] in "\"'"
        yield m["name"], [("lit", lo + quoted, hi - quoted)]
    for m in ELEMENT.finditer(text):
        value = m["value"].rstrip()
        quoted = len(value) > 1 and value[0] in "\"'"
        yield m["name"], [("lit", m.start("value") + quoted, m.start("value") + len(value) - quoted)]
    for m in URL.finditer(text):
        yield "password", [("lit", *m.span("value"))]


class Constant:
    """What a name was given: literals and other constants; and their value, once it is known."""

    def __init__(self, text: str, operands: list[tuple], given: dict[str, "Constant"]):
        own, of = set(), {}
        for o in operands:
            if o[0] == "lit":
                own.add(o)
            elif o[1] in given:
                of[id(given[o[1]])] = given[o[1]]
            elif any(c.isdigit() for c in o[1]):
                own.add(("lit", o[2], o[3]))                 # a bare word with digits that names nothing is a value
        self.text, self.own, self.of, self.value = text, sorted(own), list(of.values()), None

    def whole(self) -> Value:
        """The value of all literals, through all names, in the order of the text."""
        found, seen, todo = set(), set(), [self]
        while todo:
            c = todo.pop()
            if id(c) not in seen:
                seen.add(id(c))
                found.update(c.own)
                todo += c.of
        v = Value()
        v.extend(self.text, sorted(found))
        return v

    def known(self) -> Value:
        """The value, by what follows the last known one along a line of single names: a constant that
        is built piece by piece hands its value on, so each piece is read once."""
        line, c = [], self
        while c.value is None and len(c.of) == 1:
            line.append(c)
            c = c.of[0]
        if c.value is None:
            c.value = c.whole()
        for nxt in reversed(line):
            v, c.value = c.value, None
            nxt.value = v if v.extend(self.text, nxt.own) else nxt.whole()
            c = nxt
        return self.value


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants."""
    given: dict[str, Constant] = {}
    out = set()
    for name, operands in lex(text):
        c = Constant(text, operands, given)
        name = name.strip("\"'")
        given[name] = c
        weight, vague = sensitivity(name)
        if not weight:
            continue
        # own literals are added to a copy: the constant that they follow may go on in another way
        base = c.of[0].known() if len(c.of) == 1 else None
        if base and c.own and c.own[0][1] <= base.start:
            base = None
        if base:
            v = base.copy()
            v.extend(text, c.own)
        else:
            v = c.whole()
        if weight * v.plausibility("passphrase" in name.lower()) >= THRESHOLD and not (vague and v.reads_as_words()):
            if base:
                out.update((lo, hi, "literal") for _, lo, hi in base.literals[base.reported:] if hi > lo)
                base.reported = len(base.literals)
            out.update((lo, hi, "literal") for _, lo, hi in v.literals if hi > lo)
    return sorted(out)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start and then kind as listed."""
    if not text:
        return []
    found = base_spans(text)
    if "=" in text or ":" in text or "--" in text or "</" in text or "('" in text or '("' in text:
        found += literal_spans(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in ta.text_batches(batches):
        found = [spans(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found], _SPANS)],
            names=["doc_id", "spans"])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[(s["start"], s["end"], s["kind"]) for s in r] for r in b.column("spans").to_pylist()]
        count = lambda kind: pa.array([sum(x[2] == kind for x in r) for r in rows], pa.int64())
        base = [_written([x for x in r if x[2] != "literal"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), count("assign"), count("access"), count("hex"),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([_written(r) for r in rows])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans as text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan(docs).mapInArrow(_digest, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, "
                                          "base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every span replaced by its kind in angle brackets."""
    def run(batches):
        for b in ta.text_batches(batches):
            out = []
            for t in b.column("text").to_pylist():
                done, at = [], 0
                for s, e, k in spans(t):
                    if s >= at:
                        done += [t[at:s], f"<{k}>"]
                        at = e
                out.append("".join(done) + (t or "")[at:] if t is not None else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")
