"""Personal data: fixed rules for plain forms, and boosted trees over high-recall candidates for the rest.

The rules find e-mail addresses, IPv4 addresses, payment cards and international phone numbers. Generators
then propose overlapping spans that the rules miss: parts of longer digit runs, national phone formats,
disguised addresses. Gradient-boosted trees judge each candidate by its format and its context, and a
threshold a kind, calibrated for precision on cases that the trees were not fitted on, selects spans.
Training cases are generated from a seed: there is no labelled personal data.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import boost
from barloom.llm.text import buffers

KINDS = ("email", "ip", "card", "phone")
#: Training cases, the share of them kept for calibration, and the precision that a threshold must reach there.
CASES, KEPT, PRECISION = 15_000, 0.3, 0.98
#: Candidates whose features are held at once.
JUDGED = 8192
Span = tuple[int, int, int]  # kind, start, end

# The base rules.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What any of the number rules can match lies within such a run.
_RUN = re.compile(r"[+(]{0,2}[0-9][0-9\x20().-]*")
_GROUP = re.compile(r"[0-9]+")
#: What may stand between two digit groups of one number, numbered.
_GAPS = {"".join(x): k for k, x in enumerate(x for n in (1, 2, 3) for x in product(" ().-", repeat=n))}
_VEILED = re.compile(r"[\w.+%-]{1,64}\s{0,3}(?:@|[\[({<]\s?at\s?[\])}>]|\sat\s)\s{0,3}[\w-]{1,63}(?:\s{0,3}(?:\.|[\[({<]\s?dot\s?[\])}>]|\sdot\s)\s{0,3}[\w-]{1,63}){1,6}", re.I)
_VEILS = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\sdot\s|[\[({<]\s?dot\s?[\])}>]", re.I)


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = 0
    for place, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def base_spans(text: str) -> list[Span]:
    """What the fixed rules find, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    floor = 0  # no local part reaches back over an earlier @
    while at >= 0:
        start = at
        while start > max(done, floor) and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        floor = at + 1
        at = text.find("@", at + 1)
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        piece = run.group()
        for m in _IP.finditer(piece):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, a + m.start(), a + m.end()))
        for m in _CARD.finditer(piece):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((2, a + m.start(), a + m.end()))
        for m in _PHONE.finditer(piece):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((3, a + m.start(), a + m.end()))
    return out


class _Groups:
    """The digit groups of texts, as arrays: which text, start, end, the run a group is in, and what is between a
    group and the next one of its run, as one bit of three words (none after the last, or over more than 3 signs)."""

    def __init__(self, texts: list[str]) -> None:
        text, start, end, run, gap = [], [], [], [], []
        number = -1
        for k, t in enumerate(texts):
            for m in _RUN.finditer(t):
                a, b = m.span()
                if b - a < 7:
                    continue
                number += 1
                for g in _GROUP.finditer(t, a, b):
                    if run and run[-1] == number:
                        gap.append(_GAPS.get(t[end[-1] : g.start()], -1))
                    elif run:
                        gap.append(-1)
                    text.append(k)
                    start.append(g.start())
                    end.append(g.end())
                    run.append(number)
        gap.append(-1)
        self.text, self.start, self.end, self.run = (np.array(x, np.int64) for x in (text, start, end, run))
        self.gap = np.array(gap[: len(run)], np.int64)
        self.bits = np.zeros((len(run), 3), np.uint64)
        at = np.flatnonzero(self.gap >= 0)
        self.bits[at, self.gap[at] // 64] = np.uint64(1) << (self.gap[at] % 64).astype(np.uint64)


def _spans_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, kind, start, end) of all proposals made of digit groups, those of one number of groups at a time.

    A piece of a list is no proposal: groups whose two neighbours on either side are joined on by separators
    that are all among its own inner ones.
    """
    g = _Groups(texts)
    n = len(g.start)
    digits = np.concatenate([[0], np.cumsum(g.end - g.start)])
    inner = np.zeros((n, 3), np.uint64)
    least = np.zeros(n, np.int64)  # of the inner gaps: -1 if one of them cannot be crossed
    bits = np.concatenate([g.bits, np.zeros((2, 3), np.uint64)])
    crossed = np.concatenate([g.gap >= 0, [False, False]])
    before = np.concatenate([np.zeros((2, 3), np.uint64), g.bits])[:n], np.concatenate([np.zeros((1, 3), np.uint64), g.bits])[:n]  # gaps two and one before
    behind = np.concatenate([[False, False], g.gap >= 0])[:n], np.concatenate([[False], g.gap >= 0])[:n]
    for more in range(19):  # more groups after the first: a group has a digit at least
        here = n - more
        if here <= 0:
            return
        if more:
            inner, least = inner[:here] | g.bits[more - 1 : more - 1 + here], np.minimum(least[:here], g.gap[more - 1 : more - 1 + here])
        size = digits[more + 1 :] - digits[:here]
        fits = (least >= 0) & (size >= 7) & (size <= 19)
        if more == 3:
            fits |= (least >= 0) & (size >= 4) & (size <= 12)
        at = np.flatnonzero(fits)
        if not len(at):
            if more and not ((least >= 0) & (size < 19)).any():
                return
            continue
        own, last = inner[at], at + more
        listed = lambda b: ((b & ~own) == 0).all(1)  # noqa: B023, E731
        piece = crossed[last] & crossed[last + 1] & behind[0][at] & behind[1][at]
        piece &= listed(bits[last]) & listed(bits[last + 1]) & listed(before[0][at]) & listed(before[1][at])
        at = at[~piece]
        size, text, start, end = size[at], g.text[at], g.start[at], g.end[at + more]
        kinds = [(2, size >= 13), (3, (size >= 7) & (size <= 15))]
        if more == 3:
            dots = g.gap[at] == _GAPS["."]
            dots &= (g.gap[at + 1] == _GAPS["."]) & (g.gap[at + 2] == _GAPS["."])
            kinds.append((1, dots & (size <= 12)))
        for kind, on in kinds:
            if on.any():
                first = start[on]
                if kind == 3:  # with the sign or bracket before it
                    first = np.array([_front(texts[k], a) for k, a in zip(text[on].tolist(), first.tolist(), strict=True)], np.int64)
                yield text[on], np.full(int(on.sum()), kind), first, end[on]


def _front(text: str, a: int) -> int:
    front = a - 1 if a and text[a - 1] in "+(" else a
    return front - 1 if front < a and front and text[front - 1] == "+" else front


def proposals(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """High-recall spans of all texts, which overlap each other: (text, kind, start, end), in that order.

    Their number is in proportion to the texts, and small in lists of numbers.
    """
    parts = list(_spans_of(texts))
    veiled = [(k, 0, m.start(), m.end()) for k, t in enumerate(texts) if _VEILS.search(t) for m in _VEILED.finditer(t)]
    if veiled:
        parts.append(tuple(np.array(x, np.int64) for x in zip(*veiled, strict=True)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, kind, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((end, start, kind, text))
    return text[order], kind[order], start[order], end[order]


def candidates(text: str) -> list[Span]:
    """proposals() of one text."""
    _, *columns = proposals([text])
    return list(zip(*(c.tolist() for c in columns), strict=True))


_WORDS = (
    re.compile(r"phone|tel\b|tel[.:]|call|mobil|fax|cell|dial|ring|number", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|pay|carte|tarjeta|karte", re.I),
    re.compile(r"\bip\b|host|server|address|addr|login|from", re.I),
    re.compile(r"mail|contact|write|reach|courriel|correo", re.I),
    re.compile(r"order|isbn|version|ver\b|invoice|serial|id\b|ref|page|section|article|total|sku|tracking", re.I),
)


def _kind_of(ch: str) -> int:
    return 0 if not ch else 1 if ch.isspace() else 2 if ch.isdigit() else 3 if ch.isalpha() else 4 if ch in ".,;:!?" else 5


class Places:
    """Base spans of a text by kind; within a kind they do not overlap, so their ends are in order too."""

    def __init__(self, base: list[Span]) -> None:
        self.starts: list[list[int]] = [[] for _ in KINDS]
        self.ends: list[list[int]] = [[] for _ in KINDS]
        for kind, a, b in sorted(base):
            self.starts[kind].append(a)
            self.ends[kind].append(b)

    def overlaps(self, kind: int, a: int, b: int) -> bool:
        """Whether a span of that kind overlaps [a, b)."""
        k = bisect_left(self.ends[kind], a + 1)
        return k < len(self.starts[kind]) and self.starts[kind][k] < b


def features(text: str, span: Span, base: Places) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, a, b = span
    s = text[a:b]
    groups = _GROUP.findall(s)
    d = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, a - 24) : a], text[b : b + 12]
    seps = re.sub(r"[0-9]", "", s)
    tail = re.split(r"\W+", s)[-1]
    row = [kind, len(s), len(d), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), float(bool(d) and luhn(d)), int(d[0]) if d else -1]
    row += [float(s[:1] == "+"), float("(" in s), float(s.count("(") != s.count(")")), len(set(seps)), s.count("."), s.count("-"), s.count(" "), float("  " in s)]
    row += [float(len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)), float(any(len(g) > 1 and g[0] == "0" for g in groups))]
    row += [_kind_of(before[-1:]), _kind_of(after[:1]), float(bool(re.search(r"[0-9][ ().-]{0,2}$", before))), float(bool(re.match(r"[ ().-]{0,2}[0-9]", after))), float(before[-1:] in ("+", "(")), float(sizes[-3:] == [3, 3, 4]), float(sizes[-2:] == [3, 4]), float(sizes == [4, 4, 4, 4])]
    row += [float(bool(w.search(before))) for w in _WORDS]
    row += [float("@" in s), len(tail), float(tail.isalpha() and tail.islower()), float(bool(re.search(r"[\[({<]", s))), float(" at " in s.lower()), float(" dot " in s.lower())]
    row += [float(base.overlaps(kind, a, b)), float(any(base.overlaps(k, a, b) for k in range(len(KINDS)) if k != kind))]
    return row


# ---- generated training cases


def _card(r: random.Random) -> str:
    n = r.choice((16, 16, 16, 16, 15, 14, 19))
    body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(n - 2))
    body += next(c for c in "0123456789" if luhn(body + c))
    form = r.random()
    if n == 16 and form < 0.4:
        return r.choice((" ", "-")).join(body[k : k + 4] for k in (0, 4, 8, 12))
    return body


def _phone(r: random.Random) -> str:
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    area, mid, end = r.choice("23456789") + num(2), r.choice("23456789") + num(2), num(4)
    return r.choice((f"+1 ({area}) {mid}-{end}", f"+1 {area} {mid} {end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+44 20 {num(4)} {num(4)}", f"+49 {num(3)} {num(7)}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"1-{area}-{mid}-{end}", f"+1{area}{mid}{end}", f"+34 {num(3)} {num(3)} {num(3)}", f"+1-{area}-{mid}-{end}"))


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randint(1, 255)) for _ in range(4))


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))


def _email(r: random.Random) -> str:
    local = _name(r) + r.choice(("", f".{r.randint(0, 99):02d}", f".{_name(r)}", f"_{_name(r)}"))
    at, dot = r.choice((("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" at ", " dot "), (" [at] ", "."), (" @ ", "."), ("{at}", "{dot}")))
    host = _name(r) + r.choice(("", str(r.randint(1, 9))))
    return local + at + dot.join([host, *([_name(r)] if r.random() < 0.4 else []), r.choice(("com", "org", "net", "de", "fr", "es", "io", "edu", "co"))])


def _decoy(r: random.Random) -> str:
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    return r.choice((f"version {r.randint(1, 30)}.{r.randint(0, 99)}.{r.randint(0, 9)}.{r.randint(256, 4000)}", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(10, 23)}:{r.randint(10, 59)}", f"{num(8)}-{num(4)}-{num(6)}", f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"order {num(r.randint(7, 20))}", f"{num(3)} {num(3)} {num(3)}", f"{num(5)}.{num(8)}", f"pages {num(3)}-{num(3)}", f"{num(2)}.{num(2)}.{num(4)}", f"total 1.{num(3)}.{num(3)}.{num(3)}", f"{num(1)} ({num(4)}) {num(4)}", f"meet {_name(r)} at {_name(r)}. {_name(r).capitalize()} {_name(r)}", f"{_name(r)} at {_name(r)}.{_name(r).capitalize()}", f"id {num(16)}", f"{num(4)}-{num(4)} {num(4)}", f"{r.randint(1950, 2030)}-{r.randint(1950, 2030)}", " ".join(num(r.randint(1, 3)) for _ in range(r.randint(3, 9)))))


def _cases(n: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in generated lines."""
    r = random.Random(seed)
    xs, ys, kinds = [], [], []
    hints = {0: ("mail", "contact", "e-mail:", "write to"), 1: ("ip", "server", "host", "from"), 2: ("card", "visa", "pay with", "credit card:"), 3: ("tel.", "call", "phone:", "fax")}
    make = (_email, _ip, _card, _phone)
    while len(xs) < n:
        text, truth = "", set()
        for _ in range(r.randint(1, 5)):
            text += " ".join(_name(r) for _ in range(r.randint(0, 4))) + " "
            for _ in range(r.choice((1, 1, 2))):  # at times one right after another
                k = r.randrange(4)
                if r.random() < 0.62:
                    if r.random() < 0.3:
                        text += r.choice(hints[k]) + " "
                    s = make[k](r)
                    truth.add((k, len(text), len(text) + len(s)))
                    text += s + r.choice((" ", " ", ", ", ". ", "; "))
                else:
                    text += _decoy(r) + r.choice((" ", ", ", ". "))
        base = Places(base_spans(text))
        for c in candidates(text):
            xs.append(features(text, c, base))
            ys.append(c in truth)
            kinds.append(c[0])
    return np.array(xs, float), np.array(ys, float), np.array(kinds)


@dataclass
class Model:
    trees: boost.Boosted
    thresholds: tuple[float, ...]

    def add(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """For each text the base spans, and all spans, both in order of start, then kind."""
        found = [base_spans(t) for t in texts]
        extra: list[list[tuple[float, Span]]] = [[] for _ in texts]
        # candidates are judged JUDGED at a time: only those that are chosen are kept
        text, kind, start, end = proposals(texts)
        known: set[Span] = set()
        places, now = Places([]), -1
        for low in range(0, len(text), JUDGED):
            owner, spans, rows = [], [], []
            for k, *c in zip(*(x[low : low + JUDGED].tolist() for x in (text, kind, start, end)), strict=True):
                if k != now:
                    now, known, places = k, set(found[k]), Places(found[k])
                if tuple(c) not in known:
                    owner.append(k)
                    spans.append(tuple(c))
                    rows.append(features(texts[k], c, places))
            if rows:
                for k, c, v in zip(owner, spans, self.trees.probability(np.array(rows, float)), strict=True):
                    if v >= self.thresholds[c[0]]:
                        extra[k].append((float(v), c))
        order = lambda s: (s[1], s[0])
        out = []
        for text, base, more in zip(texts, found, extra, strict=True):
            spans = list(base)
            if more:
                taken = bytearray(len(text))  # base spans of different kinds may overlap, added ones overlap none
                for _, a, b in base:
                    taken[a:b] = b"\1" * (b - a)
                for _, c in sorted(more, key=lambda z: (-z[0], z[1])):
                    if taken.find(1, c[1], c[2]) < 0:
                        taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
                        spans.append(c)
            out.append((sorted(base, key=order), sorted(spans, key=order)))
        return out


@cache
def train(cases: int = CASES) -> Model:
    """Trees and calibrated thresholds from generated cases, fitted once a process."""
    x, y, kinds = _cases(cases)
    held = np.random.default_rng(3).random(len(x)) < KEPT
    trees = boost.fit(x[~held], y[~held], trees=120, depth=4)
    p = trees.probability(x[held])
    cut = []
    for k in range(len(KINDS)):
        own = kinds[held] == k
        order = np.argsort(-p[own])
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        cut.append(max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1)
    return Model(trees, tuple(cut))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(48, 58), 64]] = True


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with base_spans and pii_spans added: arrays of (kind, start, end) in code points, end exclusive.

    kind is an index into KINDS. Null and empty texts have no spans; columns of the added names are replaced;
    equal texts get equal spans.
    """
    docs = docs.drop("base_spans", "pii_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("base_spans", _SPANS), T.StructField("pii_spans", _SPANS)])
    column, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            buf, offs = buffers(batch.column(column))
            signs = np.concatenate([[0], np.cumsum(_SIGNS[buf])])
            some = signs[offs[1:]] > signs[offs[:-1]]
            texts = batch.column(column).to_pylist()
            base: list = [[]] * len(texts)
            spans: list = [[]] * len(texts)
            # a text without a digit or @ can only hold an address in words
            work = [k for k, t in enumerate(texts) if t and (some[k] or " dot " in t or "at]" in t or "at)" in t or _VEILS.search(t))]
            for k, (x, y) in zip(work, model.add([texts[k] for k in work]), strict=True):
                base[k] = [{"kind": a, "start": b, "end": c} for a, b, c in x]
                spans[k] = [{"kind": a, "start": b, "end": c} for a, b, c in y]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, _ARROW), pa.array(spans, _ARROW)], names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the hash of their list, and the list of all spans, in place of the arrays.

    Without spans the counts are 0, the hash is that of the empty text and the list is empty. Rows that repeat
    are told alike; an empty table gives no rows.
    """
    name = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = found
    of_kind = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    for i, k in enumerate(KINDS):
        out = out.withColumn(f"n_{k}", of_kind(i))
    return out.withColumn("base_sha256", F.sha2(listed("base_spans").cast("binary"), 256)).withColumn("spans", listed("pii_spans")).drop("base_spans", "pii_spans")
