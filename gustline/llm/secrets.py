"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived
(``trigram_query``): an OR of ANDs of the lower-case trigrams that any match
must hold. The documents' postings for these trigrams are intersected to find
each rule's candidate documents, and only candidates are verified with the
regular expression itself. A rule without mandatory trigrams scans all texts.

Only trigrams that some rule asks for are indexed: no others can be looked up.

Spans without Python: ``regexp_replace`` puts a private-use mark around each
match, ``split`` cuts the text at the marks, and the running lengths of the
pieces are the positions in code points (marks in the text itself are first
replaced by another private-use character, which keeps all lengths).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import col, replace_columns, stage, whole_text

MARK, NOT_MARK = "", ""
MATCHES_PER_CHUNK = 128
MAX_EXACT = 64  # strings that a part of an expression may stand for before it counts as open


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` has no groups, or two whose second is the
    secret itself; it must have the same meaning in Java and Python. ``least``
    is the length that the secret (or the whole match) must have: shorter
    matches are dropped and what they cover isn't searched again."""
    kind: str
    pattern: str
    least: int = 0
    any_case: bool = False
    grouped: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# The kinds that every scan reports, in the order of their reports.
BASE = (
    Rule("assign", r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
         12, any_case=True, grouped=True),
    # a run that is long enough starts at its first character: no need to match the short ones
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Documented public formats of further kinds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%+-]{1,64}:[^\s/:@]{1,128}@"),
)


# -- trigram queries ----------------------------------------------------------------
# An OR of ANDs as a set of sets of trigrams; None stands for "any text".
Query = frozenset | None


def _absorb(terms) -> Query:
    """Drop terms that a shorter one implies; an empty term matches any text."""
    terms = set(terms)
    if frozenset() in terms:
        return None
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return a if b is None else b
    return _absorb(x | y for x, y in itertools.product(a, b))


def _of_strings(strings: set[str]) -> Query:
    return _absorb(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _exact(node) -> set[str] | None:
    """The lower-case strings that one parsed item can match, if they are few."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        out: set[str] = set()
        for kind, v in arg:
            if kind is rc.LITERAL:
                out.add(chr(v).lower())
            elif kind is rc.RANGE and v[1] - v[0] < MAX_EXACT:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out
    if op is rc.SUBPATTERN:
        return _exact_all(arg[3])
    if op is rc.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[1] is not rc.MAXREPEAT and arg[1] <= 4:
        one = _exact_all(arg[2])
        if one is None or len(one) ** arg[1] > MAX_EXACT:
            return None
        return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(one, repeat=n)}
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for node in items:
        one = _exact(node)
        if one is None or len(one) * len(out) > MAX_EXACT:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(items) -> Query:
    """Query of parsed items in a row: runs of items that stand for few strings
    give their trigrams, the others what must be inside them."""
    query: Query = None
    run = {""}
    for node in items:
        one = _exact(node)
        if one is not None and len(one) * len(run) <= MAX_EXACT:
            run = {a + b for a in run for b in one}
            continue
        query = _and(query, _of_strings(run))
        run = {""}
        if one is not None:
            if len(one) <= MAX_EXACT:
                run = one
            continue
        op, arg = node
        if op is rc.SUBPATTERN:
            query = _and(query, _query(arg[3]))
        elif op is rc.BRANCH:
            parts = [_query(p) for p in arg[1]]
            if None not in parts:
                query = _and(query, _absorb(itertools.chain(*parts)))
        elif op is rc.MAX_REPEAT and arg[0] > 0:
            query = _and(query, _query(arg[2]))
    return _and(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of lower-case trigrams that the lower-case text around every
    match of ``pattern`` holds; None if there is no mandatory one."""
    return _query(_flat(rp.parse(pattern)))


def _flat(items) -> list:
    """Plain groups at the top level opened up, so that runs go on across them."""
    out = []
    for op, arg in items:
        if op is rc.SUBPATTERN and _exact_all(arg[3]) is None:
            out += _flat(arg[3])
        else:
            out.append((op, arg))
    return out


# -- candidates -----------------------------------------------------------------------
def postings(docs: DataFrame, key: Column, text: Column, trigrams: list[str]) -> DataFrame:
    """trigram, key: the inverted index, one row for each of the trigrams that
    a text holds (in lower case)."""
    low = docs.select(key.alias("key"), F.lower(text).alias("low"))
    held = F.array(*[F.when(F.col("low").contains(t), F.lit(n)) for n, t in enumerate(trigrams)])
    return low.select("key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(docs: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules (bit r: rule r's trigram query holds), for keys with any."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries if q for term in q for t in term})
    number = {t: n for n, t in enumerate(trigrams)}
    rows = []  # rule, term, trigram, its bit in the term, all the term's bits
    for r, q in enumerate(queries):
        for n, term in enumerate(sorted(map(sorted, q or ()))):
            rows += [(r, n, number[t], 1 << b, (1 << len(term)) - 1) for b, t in enumerate(term)]
    spark = docs.sparkSession
    values = ", ".join(f"({r}, {n}, {t}, {b}L, {a}L)" for r, n, t, b, a in rows) or "(0, 0, -1, 1L, 1L)"
    terms = spark.sql(f"SELECT * FROM VALUES {values} AS t(rule, term, trigram, bit, bits)")
    # the terms are the rules' own: a few dozen rows
    return (postings(docs, key, text, trigrams).join(F.broadcast(terms), "trigram")
            .groupBy("key", "rule", "term", "bits").agg(F.bit_or("bit").alias("have")).filter("have = bits")
            .groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules")))


# -- spans ------------------------------------------------------------------------------
def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, no, end>> of the rule's matches, in text order.

    An array can only be added to by copying it, so the pieces between marks
    are gone through in chunks of bounded length whose results are joined once:
    the time per match doesn't grow with their number."""
    parts = 3 if rule.grouped else 2  # pieces per match, with the one before it
    marked = F.regexp_replace(text, rule.java, f"{MARK}$1{MARK}$2{MARK}" if rule.grouped else f"{MARK}$0{MARK}")
    kind = "array<struct<start:int,no:int,end:int>>"
    chunk = parts * MATCHES_PER_CHUNK

    def spans_of(sizes: Column, first: Column) -> Column:
        """Matches of one chunk, which begins with the piece before a match."""
        start = F.struct(first.alias("at"), F.lit(0).alias("n"), F.lit(0).alias("begin"),
                         F.array().cast(kind).alias("out"))

        def step(acc: Column, size: Column) -> Column:
            turn = acc["n"] % parts
            begin = F.when(turn == 1, acc["at"]).otherwise(acc["begin"])
            hit = (turn == parts - 1) & (size >= rule.least)
            span = F.array(F.struct(begin.alias("start"), F.lit(number).alias("no"), (acc["at"] + size).alias("end")))
            return F.struct((acc["at"] + size).alias("at"), (acc["n"] + 1).alias("n"), begin.alias("begin"),
                            F.when(hit, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(sizes, start, step, lambda acc: acc["out"])

    def begins(chunks: Column) -> Column:
        """Where each chunk begins in the text."""
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(totals, start, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def all_spans(sizes: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int"))
        chunks = F.transform(places, lambda c: F.slice(sizes, c * chunk + 1, F.lit(chunk)))
        return _let(chunks, lambda cs: _let(begins(cs), lambda at: F.flatten(
            F.transform(cs, lambda c, n: spans_of(c, F.get(at, n))))))

    # most texts have no match, which leaves one piece
    found = _let(F.transform(F.split(marked, MARK), F.char_length), lambda sizes: F.when(
        F.size(sizes) > 1, all_spans(sizes)).otherwise(F.array().cast(kind)))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` with ``secrets``: array<struct<start, no, end>>, the spans of all
    rules (``no`` is the rule's place in ``rules``; code points, end exclusive)
    by start, then rule.

    NULL text is an empty text and has none. Rows are found again by a hash of
    id and text: repeated rows (and colliding ones) share their candidates,
    which verification makes harmless. NULL ids, empty tables and texts of any
    length are handled alike; an input column named ``secrets`` is replaced.
    """
    text = whole_text(text_col)
    key = F.xxhash64(col(id_col), text)
    # written, so that its size is known before any text moves: where the
    # candidates are few they are sent to the texts
    found = stage(candidates(docs, key, text, rules), "secret-candidates")
    known = "_rules"
    while known in docs.columns:
        known = "_" + known
    joined = docs.join(found.select(F.col("key").alias("_key" + known), F.col("rules").alias(known)),
                       key == F.col("_key" + known), "left").drop("_key" + known)
    safe = F.when(text.contains(MARK), F.translate(text, MARK, NOT_MARK)).otherwise(text)
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")
    spans = []
    for n, rule in enumerate(rules):
        own = rule_spans(safe, rule, n)
        if trigram_query(rule.pattern) is not None:
            own = F.when(F.col(known).bitwiseAND(F.lit(1 << n)) != 0, own).otherwise(none)
        spans.append(own)
    return replace_columns(joined, {"secrets": F.sort_array(F.concat(*spans))}).drop(known)


def report(spans: Column, rules: tuple[Rule, ...] = BASE + ADDED) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``scanned`` (a result of ``scan``) with every span of its text replaced
    by ``mask``, overlapping spans as one, and without ``secrets``. A NULL text
    stays NULL."""
    text = col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        add = F.when(s["end"] > acc["at"], F.concat(
            F.substring(text, acc["at"] + 1, begin - acc["at"]),
            F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(F.lit("")))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    done = F.aggregate("secrets", start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    new = F.when(F.size("secrets") > 0, done).otherwise(text)
    return scanned.select(*[new.alias(c) if c == text_col else col(c) for c in scanned.columns if c != "secrets"])
