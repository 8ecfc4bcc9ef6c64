"""Personal data spans: fixed patterns plus a semi-Markov conditional random field.

The patterns (``base_spans``) always count. The field then labels what they leave:
around every digit and @ a region is cut into atoms (runs of letters or digits,
single other characters), and any run of atoms with the outline of an address or
a number is a candidate segment. Features of a whole segment (its shape, digit
groups, check digit, the word before it, ...) give each kind a score; dynamic
programming over the region, with segments of bounded length, chooses the
boundaries and kinds that are best together. Atoms outside any entity score 0.

Weights are learned here, by gradient ascent on the field's likelihood over a
bounded sample of documents. The patterns' own spans are the labels, as they
stand and rewritten the way people write them too (``rewritten``: "(at)" for @,
telephone numbers without the country's), so the field adds what the patterns
miss.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import col, replace_columns, smallest_hashes, whole_text

KINDS = ("email", "ip", "card", "phone")  # in the order of reports
FIT_DOCUMENTS = 2000  # documents that the weights are learned from, at most
EPOCHS, RATE, DECAY = 6, 0.5, 1e-3
MAX_ATOMS = 24  # of one entity
# The outlines of the base kinds (runs taken whole, as the leftmost match does).
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Regions and candidate segments of the field.
CORE = re.compile(r"[0-9@]\S{0,120}(?:\x20[(+\[-]?\S{0,40}[0-9@]\S{0,120}|\x20[(\[](?:at|dot)[)\]])*")
SPELT = re.compile(r"[(\[]at[)\]]\x20?[\w-]{1,63}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[\w-]{1,63})+")
LOCAL = re.compile(r"[\w.%+-]{1,64}\x20?\Z")
ATOM = re.compile(r"[^\W_]+|\S")
OCTETS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
NUMBER_HEAD = re.compile(r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){6,18}")  # the longest number that starts here
LEAST_CHARS, MOST_CHARS = 7, 96  # of one entity
BEFORE, AFTER = 16, 6  # characters of context that features look at
ZEROS = str.maketrans("123456789", "000000000")
REMEMBERED = 50_000
GOES_ON = re.compile(r"\x20?[(\[]dot[)\]]|[.\x20-][0-9]|\.\w")
ADDRESS = re.compile(r"[\w.%+-]+\x20?(?:@|[(\[]at[)\]])\x20?[\w-]+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[\w-]+)+")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9])+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches that pass their tests,
    by start, then kind; failing matches are dropped and not searched again."""
    out = []
    if "@" in text:
        taken = 0
        for m in EMAIL_TAIL.finditer(text):
            at = m.start()
            begin = at
            while begin > taken and not EMAIL_HEAD.match(text, begin - 1):
                begin -= 1
            if begin < at:
                out.append((begin, 0, m.end()))
                taken = m.end()
    for m in IP.finditer(text):
        # without leading zeros: int() refuses very long strings
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- candidate segments ----------------------------------------------------------
@dataclass
class Region:
    """Atoms (their starts and ends) and candidates (first atom, last atom + 1,
    features of the whole segment)."""
    starts: list[int]
    ends: list[int]
    segments: list[tuple[int, int, list[int]]] = field(default_factory=list)


def regions(text: str, taken: list[tuple[int, int, int]] = ()) -> list[Region]:
    """Regions that hold candidates not overlapping the spans ``taken``, with
    their features (for learning; ``Scorer`` gathers none)."""
    found = (_region(text, _gaps(begin, end, blocked)) for begin, end, blocked in _open_ranges(text, taken))
    return [r for r in found if r.segments]


def _open_ranges(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list]]:
    """Each range with the spans of ``taken`` that reach into it."""
    t = 0
    for begin, end in _ranges(text):
        while t < len(taken) and taken[t][2] <= begin:
            t += 1
        blocked = []
        for n in range(t, len(taken)):
            if taken[n][0] >= end:
                break
            blocked.append(taken[n])
        yield begin, end, blocked


def _zeroed(text: str, ranges: list[tuple[int, int, list]]) -> str:
    """The text with zeros for the digits in and around the ranges."""
    parts, at = [], 0
    for begin, end, _ in ranges:
        lo, hi = max(at, begin - BEFORE), end + AFTER
        parts += [text[at:lo], text[lo:hi].translate(ZEROS)]
        at = max(at, hi)
    return "".join(parts) + text[at:]


def _gaps(begin: int, end: int, blocked: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the blocked spans leave of a range."""
    gaps, at = [], begin
    for s in blocked:
        gaps.append((at, s[0]))
        at = max(at, s[2])
    gaps.append((at, end))
    return [(lo, hi) for lo, hi in gaps if hi - lo >= 6]


def _ranges(text: str) -> list[tuple[int, int]]:
    """Where candidates may be: around digits and @, and spelt addresses."""
    found, at = [], 0
    while m := CORE.search(text, at):
        begin = m.start()
        while begin > at and begin > m.start() - 64 and not text[begin - 1].isspace():
            begin -= 1
        at = m.end()
        found.append((begin, at))
    if "(at" in text or "[at" in text:
        for m in SPELT.finditer(text):
            local = LOCAL.search(text[max(0, m.start() - 65):m.start()])
            if local:
                found.append((m.start() - len(local[0]), m.end()))
        found.sort()
        merged = []
        for begin, end in found:
            if merged and begin <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((begin, end))
        found = merged
    return found


def _is_candidate(s: str) -> bool:
    """Whether a segment has the outline of a number or an address. All digits
    count alike."""
    if NUMBER.fullmatch(s):
        return 7 <= sum(c.isdigit() for c in s) <= 19
    return ADDRESS.fullmatch(s) is not None


def _region(text: str, gaps: list[tuple[int, int]]) -> Region:
    r = Region([], [])
    for lo, hi in gaps:
        first = len(r.starts)
        for m in ATOM.finditer(text, lo, hi):
            r.starts.append(m.start())
            r.ends.append(m.end())
        for i in range(first, len(r.starts)):
            head = text[r.starts[i]]
            if not (head.isalnum() or head in "+("):
                continue
            for j in range(i + 1, min(i + MAX_ATOMS, len(r.starts)) + 1):
                if not text[r.ends[j - 1] - 1].isalnum():
                    continue
                s = text[r.starts[i]:r.ends[j - 1]]
                if LEAST_CHARS <= len(s) <= MOST_CHARS and _is_candidate(s):
                    r.segments.append((i, j, features(s, text[max(0, r.starts[i] - BEFORE):r.starts[i]],
                                                      text[r.ends[j - 1]:r.ends[j - 1] + AFTER])))
    return r


def features(s: str, before: str, after: str) -> list[int]:
    """Numbers (hashes) of the features of one whole segment."""
    names = _shape_features(s) + _left_features(before) + _right_features(after)
    names += [f"check={_checks(s)}", f"octets={_octets(s)}"]
    return [zlib.crc32(n.encode()) for n in names]


def _shape_features(s: str) -> list[str]:
    """What a segment looks like with all digits alike."""
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "d", s))
    groups = re.findall("[0-9]+", s)
    return [
        "bias", "shape=" + shape, "chars=" + "".join(sorted(set(shape))), f"digits={sum(c.isdigit() for c in s)}",
        f"first={s[0] if not s[0].isalnum() else shape[0]}", f"groups={len(groups)}",
        "sizes=" + "-".join(str(len(g)) for g in groups[:6]),
    ]


def _left_features(before: str) -> list[str]:
    words = re.findall(r"[^\W\d_]+", before.lower())
    return ["left=" + (before[-1:] if not before[-1:].isalnum() else "a"), "word=" + (words[-1] if words else "")]


def _right_features(after: str) -> list[str]:
    return ["right=" + (after[:1] if not after[:1].isalnum() else "a"), f"goes_on={GOES_ON.match(after) is not None}"]


def _checks(s: str) -> bool:
    digits = "".join(c for c in s if c.isdigit())
    return 12 <= len(digits) <= 19 and luhn(digits)


def _octets(s: str) -> bool:
    return OCTETS.fullmatch(s) is not None and all(int(g) <= 255 for g in s.split("."))


# -- scores of candidates, remembered by what they look like ---------------------------
class Scorer:
    """Best entities of a region without its candidates being gathered.

    Two places of a text that look alike, digits apart, have the same
    candidates with the same scores but for the check digit and the octets.
    They are worked out once per look (the characters an entity and its context
    may take, with digits as zeros) and kept within bounds, and only those
    that could gain are kept: a segment whose score isn't above zero never
    betters leaving its atoms out. The program then takes one look-up for each
    atom, however many digits a text holds.
    """

    def __init__(self, weights: dict[tuple[int, int], float]):
        self.weights = weights
        self.looks: dict[tuple, list] = {}
        self.segments: dict[str, tuple | None] = {}
        self.left: dict[str, list[float]] = {}
        self.right: dict[str, list[float]] = {}
        self.flags = {(c, o): self._sum([f"check={c}", f"octets={o}"]) for c in (False, True) for o in (False, True)}

    def _sum(self, names: list[str]) -> list[float]:
        features = [zlib.crc32(n.encode()) for n in names]
        return [sum(self.weights.get((f, k), 0.0) for f in features) for k in range(len(KINDS))]

    def _kept(self, sums: dict[str, list[float]], text: str, named) -> list[float]:
        got = sums.get(text)
        if got is None:
            if len(sums) > REMEMBERED:
                sums.clear()
            got = sums[text] = self._sum(named(text))
        return got

    def _segment(self, s: str) -> tuple | None:
        """(scores by kind, may check, may be octets) of a segment with zeros for
        digits; None if it is no candidate."""
        if s in self.segments:
            return self.segments[s]
        if len(self.segments) > REMEMBERED:
            self.segments.clear()
        got = None
        if _is_candidate(s):
            n = sum(c.isdigit() for c in s)
            got = (self._sum(_shape_features(s)), 12 <= n <= 19, OCTETS.fullmatch(s) is not None)
        self.segments[s] = got
        return got

    def _look(self, tail: str, room: int, reach: int, before: str) -> list[tuple]:
        """(atoms, length, variants) of the candidates that start here and are at
        most ``reach`` long; variants by (check, octets): (kind, score) of the
        best kind, None if not above 0."""
        out, left = [], self._kept(self.left, before, _left_features)
        for n, m in enumerate(ATOM.finditer(tail, 0, room), 1):
            if n > MAX_ATOMS or m.end() > reach:
                break
            if m.end() < LEAST_CHARS or not tail[m.end() - 1].isalnum():
                continue
            got = self._segment(tail[:m.end()])
            if got is None:
                continue
            scores, may_check, may_octets = got
            right = self._kept(self.right, tail[m.end():m.end() + AFTER], _right_features)
            variants = {}
            for check in {False, may_check}:
                for octets in {False, may_octets}:
                    total = [a + b + c + d for a, b, c, d in zip(scores, left, right, self.flags[check, octets])]
                    most = max(total)
                    variants[check, octets] = (total.index(most), most) if most > 0 else None
            if any(variants.values()):
                out.append((n, m.end(), variants))
        return out

    def best(self, text: str, plain: str, gaps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best entities of the gaps of one range;
        ``plain`` is the text with zeros for digits."""
        out = []
        for lo, hi in gaps:
            addresses = any(mark in plain[lo:hi] for mark in ("@", "at)", "at]"))
            starts, ends = [], []
            for m in ATOM.finditer(plain, lo, hi):
                starts.append(m.start())
                ends.append(m.end())
            n = len(starts)
            best, back = [0.0] * (n + 1), [None] * (n + 1)
            gain, via = {}, {}  # of the ends ahead: the best way to them so far
            for i in range(n):
                if i and i in gain:
                    value = gain.pop(i)
                    how = via.pop(i)
                    best[i], back[i] = (value, how) if value > best[i - 1] else (best[i - 1], None)
                elif i:
                    best[i] = best[i - 1]
                at = starts[i]
                reach = min(hi, at + MOST_CHARS)
                if not addresses:
                    number = NUMBER_HEAD.match(plain, at, reach)
                    if not number:
                        continue
                    reach = number.end()
                elif not (plain[at].isalnum() or plain[at] in "+("):
                    continue
                context, tail = plain[max(0, at - BEFORE):at], plain[at:reach + AFTER]
                key = (context, tail, reach - at, hi - at if hi - at < len(tail) else -1)
                look = self.looks.get(key)
                if look is None:
                    if len(self.looks) > REMEMBERED:
                        self.looks.clear()
                    look = self.looks[key] = self._look(tail, min(hi - at, len(tail)), reach - at, context)
                for atoms, length, variants in look:
                    if len(variants) == 1:
                        got = variants[False, False]
                    else:
                        s = text[at:at + length]
                        got = variants.get((_checks(s), _octets(s)))
                    if got is None:
                        continue
                    j, value = i + atoms, best[i] + got[1]
                    if value > gain.get(j, -math.inf):
                        gain[j], via[j] = value, (i, got[0])
            if n:
                value = gain.get(n, -math.inf)
                best[n], back[n] = (value, via[n]) if value > best[n - 1] else (best[n - 1], None)
            own, j = [], n
            while j:
                if back[j] is None:
                    j -= 1
                else:
                    i, k = back[j]
                    own.append((starts[i], k, ends[j - 1]))
                    j = i
            out += own[::-1]
        return out


# -- the field -----------------------------------------------------------------------
class Field:
    """Weights of (feature, kind) pairs."""

    def __init__(self, weights: dict[tuple[int, int], float] | None = None):
        self.weights: dict[tuple[int, int], float] = weights or {}
        self.scorer: Scorer | None = None

    def scored(self, r: Region) -> list[tuple[int, int, int, float, list[int]]]:
        """(first, end, kind, score, features) by end."""
        w = self.weights
        out = [(i, j, k, sum(w.get((f, k), 0.0) for f in fs), fs) for i, j, fs in r.segments for k in range(len(KINDS))]
        return sorted(out, key=lambda x: x[1])

    def decode(self, r: Region) -> list[tuple[int, int, int]]:
        """The best set of entities of a region, as (start, kind, end)."""
        n = len(r.starts)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        by_end = defaultdict(list)
        for s in self.scored(r):
            by_end[s[1]].append(s)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, _, k, score, _ in by_end[j]:
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((r.starts[i], k, r.ends[j - 1]))
                j = i
        return out[::-1]

    def added(self, text: str, taken: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
        """The best set of entities of each region of a text that don't overlap
        the spans ``taken``, as (start, kind, end)."""
        if self.scorer is None:
            self.scorer = Scorer(self.weights)
        ranges, out = list(_open_ranges(text, taken)), []
        plain = _zeroed(text, ranges) if ranges else text
        for begin, end, blocked in ranges:
            out += self.scorer.best(text, plain, _gaps(begin, end, blocked))
        return out

    def learn(self, r: Region, gold: set[tuple[int, int, int]], grads: dict, rate: float) -> None:
        """One step of gradient ascent (steps shrink with a weight's squared
        gradients so far, ``grads``)."""
        self.scorer = None
        segments, n = self.scored(r), len(r.starts)
        ending, starting = defaultdict(list), defaultdict(list)
        for s in segments:
            ending[s[1]].append(s)
            starting[s[0]].append(s)
        up, down = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            up[j] = _logsum([up[j - 1]] + [up[s[0]] + s[3] for s in ending[j]])
        for i in range(n - 1, -1, -1):
            down[i] = _logsum([down[i + 1]] + [down[s[1]] + s[3] for s in starting[i]])
        step = defaultdict(float)
        for i, j, k, score, fs in segments:
            p = math.exp(min(up[i] + score + down[j] - up[n], 0.0))
            d = ((r.starts[i], k, r.ends[j - 1]) in gold) - p
            if abs(d) > 1e-6:
                for f in fs:
                    step[f, k] += d
        for key, d in step.items():
            d -= DECAY * self.weights.get(key, 0.0)
            grads[key] += d * d
            self.weights[key] = self.weights.get(key, 0.0) + rate * d / math.sqrt(grads[key] + 1e-8)


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        documents: int = FIT_DOCUMENTS) -> Field:
    """Weights learned from at most ``documents`` documents, those with the
    smallest hashes of their ids; only their regions come to the driver."""
    some = smallest_hashes(docs.select(col(id_col).alias("id"), whole_text(text_col).alias("text")), "id", documents)
    # a hash for each document that is learned from
    chosen = some.select("h").distinct().orderBy("h").limit(documents)
    sample = some.join(F.broadcast(chosen), "h", "left_semi")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        """Texts of the regions with some room around, one per region."""
        return pd.Series([_windows(t) for t in texts], dtype=object)

    rows = sample.select("h", F.explode(cut("text")).alias("window")).orderBy("h", "window").limit(8 * documents)
    learned, grads = Field(), defaultdict(float)
    examples = []
    for row in rows.collect():
        gold = base_spans(row["window"])
        for text, spans in ((row["window"], gold), rewritten(row["window"], gold)):
            examples += [(r, set(spans)) for r in regions(text)]
    for _ in range(EPOCHS):
        for r, gold in examples:
            learned.learn(r, gold, grads, RATE)
    return learned


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its addresses and telephone numbers written in another way
    and some card numbers made invalid (which way depends on the span's own
    text), and the spans that are then in it."""
    out, moved, at, shift = [], [], 0, 0
    for s, k, e in spans:
        if s < at:
            continue
        old = new = text[s:e]
        way = zlib.crc32(old.encode()) % 3
        if k == 0:
            local, _, domain = old.partition("@")
            most, _, last = domain.rpartition(".")
            new = (f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local} [at] {domain}",
                   f"{local} (at) {most} (dot) {last}")[way]
        elif k == 2 and way:
            # no card: a shorter number, or a digit that fails the check
            digits = "".join(c for c in old if c.isdigit())
            new = digits[:7 + len(digits) % 5] if way == 1 else digits[:-1] + str((int(digits[-1]) + 3) % 10)
        elif k == 3:
            rest = re.sub(r"\A\+[0-9]+[\x20-]*", "", old)
            groups = re.findall("[0-9]+", rest)
            if sum(map(len, groups)) >= 9:
                new = (rest, "-".join(groups), " ".join(groups))[way]
        out += [text[at:s], new]
        if k != 2 or new == old:
            moved.append((s + shift, k, s + shift + len(new)))
        shift += len(new) - len(old)
        at = e
    return "".join(out) + text[at:], moved


def _windows(text: str) -> list[str]:
    """The text around each region, with some room before it."""
    return [text[max(0, begin - 32):end + 1] for begin, end in _ranges(text) if end - begin <= 2000]


def find(text: str, learned: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) of all personal data in a text."""
    base = base_spans(text)
    spans = [(*s, True) for s in base]
    spans += [(*s, False) for s in learned.added(text, base)]
    return sorted(spans)


def detect(docs: DataFrame, learned: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``personal``: array<struct<start, no, end, base>>, the spans
    in code points (end exclusive) by start, then kind (``no`` in ``KINDS``);
    ``base`` tells the fixed patterns' spans from the added ones, which never
    overlap them.

    A narrow map over whole texts. NULL text is an empty text and has none;
    repeated rows each keep their own; texts of any length are searched to
    their end; an input column of that name is replaced.
    """
    @F.pandas_udf("array<struct<start:int,no:int,end:int,base:boolean>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "no": k, "end": e, "base": b} for s, k, e, b in find(t, learned)]
                          for t in texts], dtype=object)

    return replace_columns(docs, {"personal": spans(whole_text(text_col))})


def report(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
