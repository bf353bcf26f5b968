"""Secret scan: fixed patterns, and a guess-cost dynamic program on credential values.

The base patterns give spans of kind ``assign``, ``access`` and ``hex``.  Beyond them,
values in a credential context (a name such as ``pwd`` or ``passphrase`` followed by a
separator and a value) are judged by the cheapest way to guess them: a dynamic program
finds the segmentation into words, dates, repeats, keyboard walks and brute-force spans
with the smallest product of guesses.  Values dearer than a threshold give spans of
kind ``guess``.  Everything works on bytes; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm.common import utf8

KINDS = ("assign", "access", "hex", "guess")

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: Names that open a credential context; each is looked for in lower case.
NAMES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "apikey", "api_key",
         "api-key", "accesskey", "access_key", "access-key", "privatekey", "private_key", "private-key", "auth", "bearer")
CONTEXT = re.compile(
    rb"(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key"
    rb"|auth(?:orization)?|bearer)"
    rb"""["']?(?:(?P<sign>\x20*(?:=>|:=|[:=])\x20*(?:basic\x20+|bearer\x20+)?)|\x20+(?:is\x20+)?)"""
    rb"""(?:"(?P<double>(?:[^"\\\r\n]++|\\[^\r\n])++)"|'(?P<single>(?:[^'\\\r\n]++|\\[^\r\n])++)'|["']?(?P<bare>[\x21\x23-\x26\x28-\x7e\x80-\xff]+))""", re.I)

# Common words and passwords, most frequent first.
WORDS = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon baseball iloveyou trustno1 sunshine master welcome "
    "shadow ashley football jesus michael ninja mustang login admin princess solo starwars cheese computer internet "
    "secret summer winter spring autumn orange banana flower hunter killer freedom whatever superman batman soccer "
    "hockey jordan george thomas daniel robert andrew joshua jessica pepper ginger cookie hello charlie silver purple "
    "matrix hannah access thunder tigger buster the and for are but not you all any can her was one our out day get "
    "has him his how man new now old see two way who boy did its let put say she too use that with have this will your "
    "from they know want been good much some time very when come here just like long make many more only over such take "
    "than them well were token user root test guest default changeme example sample value string none null true false "
    "key code pass word private public auth bearer basic api app web site mail email name data file server client"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4@310$57!", "aaeiossti")
LEAST_LENGTH, LONGEST_WORD, LONGEST_VALUE = 8, 32, 256
#: log10 of guesses from which a value counts as a secret, and of guesses a brute-force character costs.
STRONG, BRUTE = 10.0, 1.0

DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1+")
WALKS = [row[::step] for row in ROWS for step in (1, -1)]
NEXT = {(a, b) for walk in WALKS for a, b in zip(walk, walk[1:], strict=False)}


def _segments(value: str, ranks: dict[str, int], repeats: bool = True) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every span that a pattern explains."""
    low = value.lower()
    plain = low.translate(LEET)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + LONGEST_WORD) + 1):
            rank = ranks.get(low[i:j]) or 2 * ranks.get(plain[i:j], 0)
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                cases = 1 if not upper else 2 if upper == j - i or value[i].isupper() and upper == 1 else 2 ** min(upper, j - i - upper)
                yield i, j, math.log10(rank * cases + 1)
        if m := DATE.match(value, i):
            yield i, m.end(), math.log10(365 * 120 if len(m[0]) > 4 else 120)
        if repeats and (m := REPEAT.match(value, i)):
            unit = guess_cost(m[1], ranks, repeats=False)
            yield i, m.end(), unit + math.log10((m.end() - i) // len(m[1]))
    i = 0
    while i < len(value) - 1:
        j = i + 1
        while j < len(value) and (low[j - 1], low[j]) in NEXT:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(len(ROWS) * 12 * (j - i))
        i = j if j > i + 1 else i + 1


def guess_cost(value: str, ranks: dict[str, int], repeats: bool = True) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    A segmentation of m spans costs the sum of its spans' costs and log10(m!), for the
    order of the spans; neighbouring brute-force characters make one span.
    """
    n = len(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _segments(value, ranks, repeats):
        ends[j].append((i, cost))
    # best[j][m, brute]: cost of the first j characters as m spans, the last of which is brute force or not
    best: list[dict[tuple[int, bool], float]] = [{(0, False): 0.0}, *({} for _ in range(n))]
    for j in range(1, n + 1):
        own = best[j]
        for (m, brute), cost in best[j - 1].items():
            at = (m if brute else m + 1, True)
            own[at] = min(own.get(at, math.inf), cost + BRUTE)
        for i, step in ends[j]:
            for (m, _), cost in best[i].items():
                at = (m + 1, False)
                own[at] = min(own.get(at, math.inf), cost + step)
    return min((cost + math.lgamma(m + 1) / math.log(10) for (m, _), cost in best[n].items()), default=0.0)


class Scanner:
    def __init__(self, words: tuple[str, ...] | list[str] = tuple(WORDS), strong: float = STRONG):
        self.ranks = {w: r for r, w in reversed(list(enumerate(words, 1)))}
        self.strong = strong

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind, end) of every span of a UTF-8 text, sorted."""
        found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)] if b"AKIA" in data else []
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
        low = data.lower()
        if any(name.encode() in low for name in NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
            taken = {(s, e) for s, _, e in found}
            m = CONTEXT.search(data)
            while m:
                start, end = m.span(m.lastgroup)
                if m["bare"]:
                    end = start + len(m["bare"].rstrip(b".,;:!?)]}>"))
                value = data[start:end].decode("utf-8", "replace")
                strong = len(value) >= LEAST_LENGTH and self.is_strong(value, prose=m["sign"] is None)
                if strong and not any(s <= start and end <= e for s, e in taken):
                    found.append((start, 3, end))
                # a value that is no secret may hold a name and its value
                m = CONTEXT.search(data, m.end() if strong else m.start(m.lastgroup))
        found.sort()
        if found and not data.isascii():
            # characters before each byte: a text is read once, however many spans it has
            before = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
            found = [(int(before[s]), k, int(before[e])) for s, k, e in found]
        return found

    def is_strong(self, value: str, prose: bool = True) -> bool:
        """Whether guessing is dear.  Where a sentence can go on after the name (``prose``: no : or =),
        letters alone or digits alone are no secret; a value longer than any password (keys,
        blobs) is judged by its first pieces' sum."""
        if prose and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            return False
        cost = 0.0
        for at in range(0, len(value), LONGEST_VALUE):
            cost += guess_cost(value[at:at + LONGEST_VALUE], self.ranks)
            if cost >= self.strong:
                return True
        return False


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, words: list[str] | None = None, strong: float = STRONG) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans of every whole text.

    ``words`` replaces the dictionary (most frequent first).  A null or empty text has
    no spans.  Repeated rows each give a row; other columns are ignored.
    """
    words = list(words or WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(words, strong)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            shas, spans = [], []
            for data in utf8(batch.column("text")):
                own = scanner.scan(data)
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in own))
                shas.append(hashlib.sha256(joined([x for x in own if x[1] < 3]).encode()).hexdigest())
                spans.append(joined(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()),
                 pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text", strong: float = STRONG) -> DataFrame:
    """Replace every span by ``mask`` in ``text``; overlapping spans become one mask.
    A null text stays null; all other columns stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(strong=strong)
        for batch in batches:
            out = []
            for own, data in zip(batch.column(text).to_pylist(), utf8(batch.column(text)), strict=True):
                if own is not None and (spans := scanner.scan(data)):
                    pieces, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            pieces += [own[at:start], mask]
                        at = max(at, end)
                    own = "".join([*pieces, own[at:]])
                out.append(own)
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
