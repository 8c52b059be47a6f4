"""Personal data: exact patterns, and a linear-chain conditional random field.

The field (``Crf``) labels white-space tokens from word-shape features of a token and
its neighbours.  It is trained on the driver from a small labelled table of lines
and decoded by Viterbi in numpy batches: all token runs of a batch, padded to the
same length, take each step together; a run is decoded whole, however long.  A token without a digit, ``@`` or a written
"at" is always outside (a hard constraint of the lattice), so only runs of other
tokens need decoding, each with its neighbours as context.

Spans that the field adds must pass the checks of their kind (digits, Luhn, parts)
and not overlap a pattern span; pattern spans always stay.  A text is one row of one
task; nothing is shuffled.

Edge cases: null text is empty and has no spans; very long texts are taken whole
(every pattern is linear in the length); repeated rows are judged row by row; ties
in start are ordered by kind; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm.common import table
from loomstat.llm.kernels import steps, tidy, utf8

KINDS = ("email", "ip", "card", "phone")
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
STATES = ("O", "email", "ip", "B-card", "I-card", "B-phone", "I-phone")
#: Tokens that one step of the decoder holds (a longer single run is a step of its own).
DECODE_TOKENS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is entered at its first digit only: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LIVE = re.compile(r"[0-9@]|[\[(]at[\])]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'<>{}#*$%&|"

# The labelled lines. {kind:...} marks a span of that kind.
LABELLED = [
    "Write to {email:anna.lee@mail.example} today.", "Mail {email:bob_77@dept.school.test}, please",
    "E-mail: {email:c.smith+news@shop.example}", "contact {email:info@firm.test} or {email:sales@firm.test}",
    "from {email:x1@y2.example} at noon", "reach me: {email:maría@correo.example}", "to {email:jörg.k@post.test} soon",
    "ask {email:jane(at)office.example} first", "send it to {email:tom[at]house.test} now",
    "{email:k.m@a.b.example}", "see {email:root@localhost} for help", "the {email:admin@intranet} account",
    "Server {ip:10.20.30.40} is down", "from {ip:192.168.1.77} to {ip:172.16.0.9}", "host {ip:8.8.4.4}, port 53",
    "{ip:203.0.113.200}", "ping {ip:198.51.100.23} failed 3 times", "at {ip:127.0.0.1} only", "ip {ip:100.64.3.2}.",
    "Card {card:4111111111111111} was used", "card {card:4012 8888 8888 1881} expires 09/27",
    "number {card:5555-5555-5555-4444} please", "pay with {card:378282246310005}", "visa {card:4222222222222} ok",
    "{card:6011 1111 1111 1117}", "charged to {card:3530.1113.3330.0000} on 12 May",
    "the card {card:5105/1051/0510/5100} was lost", "on {card:4111 1111 1111 1111}, thanks",
    "Call {phone:+1 (212) 555-0147} now", "phone {phone:+44 20 7946 0958}", "tel {phone:+49 30 901820}",
    "fax {phone:+33 1 23 45 67 89} or mail", "{phone:+1-202-555-0143}", "ring {phone:+34.912.345.678} after 9",
    "Call {phone:(212) 555-0147} now", "phone {phone:(030) 901-8204}, ask for Ann", "tel {phone:212-555-0147}",
    "tel: {phone:415-555-2671} ext 12", "my number is {phone:(646) 555-0190}", "phone {phone:020 7946 0958}",
    "call {phone:555-010-9988} today", "{phone:(303) 555-0110} is busy", "Telefon {phone:030 9018 2040}",
    "mail {email:dev@node12}", "write to {email:me@srv07}, please", "from {email:ops@box3} to all",
    "ring {phone:0171 496 0123} tomorrow", "tel {phone:07700 900456}", "mobile {phone:07911 123456}, evenings",
    "call {phone:0161 496 0777}", "phone {phone:01632 960983} or write", "Tel. {phone:0131 496 0555}", "fax {phone:020 7946 0321}",
    "call me on {phone:07700 900789}", "mobile: {phone:0151 496 0888}", "{phone:0171 496 0611}", "ring {phone:01632 960471} at 9",
    "lines 12 13 14 15 {phone:(212) 555-0168}", "1 2 3 {phone:(646) 555-0121} 4 5", "12 12 12 12 12 12 {phone:(303) 555-0177}",
    "{ip:10.1.2.3} 22 80 443 {ip:10.1.2.4}", "7 8 9 {card:4111111111111111} 10 11", "from 10 to 20 call {phone:212-555-0129}",
    # Lines without personal data.
    "item 555 1234 567", "item 204 3310 882 in stock", "part 300 4521 000 of the plan", "lot 12 3456 789", "serial 4471 2209 331",
    "batch 07700 900", "order 555 010 9988", "ref 0171 496 22", "invoice 2023 0441 9982", "item 0171 4960 000", "serial 07700 900123",
    "12 12 12 12 12 12 12 12", "1 22 333 4444 55555", "10 20 30 (40) 50 60", "part 415-555-2671", "3 (2) 1 (0)",
    "In 1998 there were 12 of them.", "on 2021-03-04 at 10:30", "version 1.2.3 and 4.0", "Version 2.0.",
    "pages 120-135 of 400", "it cost 1,250.00 in 2019", "room 4.12, floor 3", "section 3.1.4", "1 2 3 4 5 6 7 8",
    "from 01/02/2003 to 05/06/2007", "the 20th of May 1875", "score 3-2 and 10-9", "a ratio of 0.375 or 37.5%",
    "token = 9f8c2e7a1b3d5f60718293a4b5c6d7e8f9012345", "id 7f3a9c", "build 20240611", "order 123456 of 99",
    "isbn 978-3-16-148410-0", "width 1024 height 768", "@home and @work", "see fig. 2 and table 10", "CC BY-NC 4.0",
    "chapter 12", "born 1901, died 1977", "temperatures of -12 to 31", "10 000 people", "100.000 Einwohner",
    "GNU license, version 3.", "5 to 7 p.m.", "call 3 friends", "1939-1945", "from 1998-2004", "in 1914-1918 and 2001/2002", "(1) first (2) second",
    "(1) (2) (3) 4567 8910", "the years 1990-1999 in 2 volumes", "lines 1000-2000", "(4) 12 34", "phone 2 of 5", "card 7 of 52", "zip 90210",
    "2 + 2 = 4", "x86-64", "H2O and CO2", "a 4x4 grid", "v1.10.2.dev3", "sha 1234abcd5678ef90", "12:45:59.120",
]
_MARK = re.compile(r"\{(\w+):([^}]*)\}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at >= last else None
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield "email", start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Pattern spans by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_part(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text)
                      if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def _run(n: int, steps_: tuple[int, ...]) -> str:
    return str(next((s for s in steps_ if n <= s), "more"))


def features(token: str) -> list[str]:
    """Word-shape features of a token; of one longer than 64 characters, those of its first 64, and that it is long."""
    if len(token) > 64:
        return [*features(token[:64]), "long"]
    shape, counts, i = [], {}, 0
    while i < len(token):
        c = token[i]
        kind = "d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else "u" if c.isalpha() else c
        j = i + 1
        while j < len(token) and (("0" <= token[j] <= "9") if kind == "d" else kind in "xXu" and token[j].isalpha()):
            j += 1
        shape.append(kind + _run(j - i, (1, 2, 3, 4, 8, 11, 19)) if kind == "d" else "x" if kind in "xXu" else kind)
        counts[kind if kind == "d" else "x" if kind in "xXu" else kind] = counts.get(kind, 0) + j - i
        i = j
    out = ["shape=" + "".join(shape), "has=" + "".join(sorted(counts)), "first=" + shape[0][0], "last=" + shape[-1][0],
           "digits=" + _run(counts.get("d", 0), (0, 1, 2, 3, 4, 6, 8, 11, 19)), "dots=" + _run(counts.get(".", 0),
                                                                                         (0, 1, 2, 3))]
    if _LIVE.search(token) is None:
        out.append("word=" + token.lower() if token.lower() in _CUES else "word")
    elif "(at)" in token or "[at]" in token:
        out.append("at")
    return out


# Words before or after a span that tell its kind.
_CUES = frozenset("call phone tel telefon fax ring number card visa mail e-mail email to contact ip host server from "
                  "ping version page pages section id token build order isbn zip mobile item part lot serial batch ref invoice".split())


def is_live(token: str) -> bool:
    return _LIVE.search(token) is not None


def core(token: str) -> tuple[int, int]:
    """Start and end of a token without the punctuation at its edges."""
    a, b = 0, len(token)
    while a < b and token[a] in _EDGE:
        a += 1
    while b > a and token[b - 1] in _EDGE:
        b -= 1
    return a, b


class Crf:
    """Linear-chain conditional random field; weights are a table feature -> states for the token, the one before and
    the one after."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.weights = np.zeros((0, len(STATES)))
        self.move = np.zeros((len(STATES), len(STATES)))

    def _columns(self, tokens: list[str], i: int) -> list[str]:
        out = ["0" + f for f in features(tokens[i])]
        out += ["-" + f for f in (features(tokens[i - 1]) if i else ["edge"])]
        return out + ["+" + f for f in (features(tokens[i + 1]) if i + 1 < len(tokens) else ["edge"])]

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Score of each state for each token; a token that is not live can only be outside."""
        out = np.zeros((len(tokens), len(STATES)))
        for i, t in enumerate(tokens):
            at = [self.names[f] for f in self._columns(tokens, i) if f in self.names]
            out[i] = self.weights[at].sum(0)
            if not is_live(t) and not (t.startswith("+") or t.startswith("(")):
                out[i, 1:] = -1e6
        return out

    def train(self, lines: list[tuple[list[str], list[int]]], rounds: int = 200, l2: float = 0.02) -> Crf:
        """Maximum likelihood by full-batch gradient steps (forward-backward over all lines at once)."""
        feats = [[self._columns(t, i) for i in range(len(t))] for t, _ in lines]
        for f in sorted({x for line in feats for cols in line for x in cols}):
            self.names[f] = len(self.names)
        n, longest, k = len(lines), max(len(t) for t, _ in lines), len(STATES)
        x = np.zeros((n, longest, len(self.names)))
        gold, live = np.zeros((n, longest, k)), np.zeros((n, longest), np.bool_)
        fixed = np.zeros((n, longest, k))
        for a, (tokens, tags) in enumerate(lines):
            for i, tag in enumerate(tags):
                x[a, i, [self.names[f] for f in feats[a][i]]] = 1
                gold[a, i, tag], live[a, i] = 1, True
                if not is_live(tokens[i]) and not tokens[i].startswith(("+", "(")):
                    fixed[a, i, 1:] = -1e6
        self.weights = np.zeros((len(self.names), k))
        self.move = np.zeros((k, k))
        pairs = np.einsum("ati,atj->ij", gold[:, :-1], gold[:, 1:])
        gw2, gm2 = np.full_like(self.weights, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(rounds):
            e = x @ self.weights + fixed
            fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            fwd[:, 0] = e[:, 0]
            for t in range(1, longest):
                step = _logsum(fwd[:, t - 1, :, None] + self.move[None], 1) + e[:, t]
                fwd[:, t] = np.where(live[:, t, None], step, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = _logsum(self.move[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(live[:, t + 1, None], step, 0.0)
            z = _logsum(fwd[:, -1], 1)
            p = np.where(live[..., None], np.exp(np.minimum(0, fwd + bwd - z[:, None, None])), 0.0)
            both = fwd[:, :-1, :, None] + self.move + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]
            q = (np.exp(np.minimum(0, both)) * live[:, 1:, None, None]).sum((0, 1))
            gw = np.einsum("atf,atk->fk", x, gold - p) - l2 * self.weights
            gm = pairs - q - l2 * self.move
            gw2 += gw ** 2
            gm2 += gm ** 2
            self.weights += 0.5 * gw / np.sqrt(gw2)
            self.move += 0.5 * gm / np.sqrt(gm2)
        return self

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Best state sequence of each run of emissions, all runs of similar length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda r: len(runs[r]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and (hi - lo + 1) * len(runs[order[hi]]) <= DECODE_TOKENS:
                hi += 1
            block, lo = order[lo:hi], hi
            length = np.array([len(runs[r]) for r in block])
            e = np.zeros((len(block), length.max(), len(STATES)))
            for a, r in enumerate(block):
                e[a, :length[a]] = runs[r]
            best, back = e[:, 0], np.zeros(e.shape, np.int64)
            for t in range(1, e.shape[1]):
                s = best[:, :, None] + self.move[None]
                back[:, t] = s.argmax(1)
                best = np.where((t < length)[:, None], s.max(1) + e[:, t], best)
            state = best.argmax(1)
            path = np.zeros(e.shape[:2], np.int64)
            for t in range(e.shape[1] - 1, -1, -1):
                path[:, t] = state
                inside = (t < length) & (t > 0)
                state = np.where(inside, back[np.arange(len(block)), t, state], state)
            for a, r in enumerate(block):
                out[r] = path[a, :length[a]]
        return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def _tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Tokens without edge punctuation, and where they stand."""
    tokens, places = [], []
    for m in _TOKEN.finditer(text):
        a, b = core(m[0])
        if a < b:
            tokens.append(m[0][a:b])
            places.append((m.start() + a, m.start() + b))
    return tokens, places


def labelled_lines(lines: list[str]) -> list[tuple[list[str], list[int]]]:
    """Tokens and states of marked lines."""
    out = []
    for line in lines:
        plain, spans, at = "", [], 0
        for m in _MARK.finditer(line):
            plain += line[at:m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain, at = plain + m[2], m.end()
        plain += line[at:]
        tokens, places = _tokens(plain)
        tags = []
        for a, b in places:
            hit = next((s for s in spans if a < s[2] and b > s[1]), None)
            name = "O" if hit is None else hit[0] if hit[0] in STATES else ("B-" if a <= hit[1] else "I-") + hit[0]
            tags.append(STATES.index(name))
        out.append((tokens, tags))
    return out


def fit(lines: list[str] | None = None) -> Crf:
    """The field trained on a small labelled table (marked lines); a few seconds on the driver."""
    return Crf().train(labelled_lines(LABELLED if lines is None else lines))


def _live_runs(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """Runs of live tokens of each line, with one token of context on either side, whole whatever their length."""
    at = 0
    while (m := _LIVE.search(text, at)) is not None:
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        b = len(text) if b < 0 else b
        start = m.start()
        while start > a and not text[start - 1].isspace():
            start -= 1
        end = start
        for t in _TOKEN.finditer(text, start, b):
            end = t.end()
            if not (is_live(t[0]) or t[0].startswith(("+", "("))):
                break
        # The token before: one run has it as the token before, so each is looked at once so.
        first = start
        while first > a and text[first - 1].isspace():
            first -= 1
        if first > a:
            while first > a and not text[first - 1].isspace():
                first -= 1
        else:
            first = start
        tokens, places = _tokens(text[first:end])
        if tokens:
            yield tokens, [(first + x, first + y) for x, y in places]
        at = max(end, m.end())


def _valid(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "ip":
        return found.count(".") == 3 and all(x.isdigit() and x.isascii() and _part(x) for x in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in found)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in found)
    return any(x in found for x in ("@", "(at)", "[at]")) and any(c.isalpha() for c in found)


def crf_spans(crf: Crf, texts: list[str]) -> list[list[Span]]:
    """Spans that the field finds in each text (checked by kind)."""
    runs, where = [], []
    for i, text in enumerate(texts):
        for tokens, places in _live_runs(text):
            runs.append(crf.emissions(tokens))
            where.append((i, places))
    out: list[list[Span]] = [[] for _ in texts]
    for (i, places), states in zip(where, crf.decode(runs)):
        span: Span | None = None
        for (a, b), s in zip(places, states):
            kind = STATES[s].split("-")[-1]
            if span and STATES[s].startswith("I-") and span[0] == kind:
                span = (kind, span[1], b)
                continue
            if span:
                out[i].append(span)
            span = None if kind == "O" else (kind, a, b)
        if span:
            out[i].append(span)
    return [[s for s in found if _valid(s[0], text[s[1]:s[2]])] for text, found in zip(texts, out)]


def all_spans(crf: Crf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text."""
    out = []
    for text, extra in zip(texts, crf_spans(crf, texts)):
        base = base_spans(text)
        ends = sorted((a, b) for _, a, b in base)
        new = [s for s in extra if not any(a < s[2] and b > s[1] for a, b in _near(ends, s))]
        out.append((base, sorted(base + new, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def _near(ends: list[tuple[int, int]], span: Span) -> list[tuple[int, int]]:
    """Base spans that can overlap ``span``: base spans of one kind do not overlap, so few start far before it."""
    from bisect import bisect_left

    at = bisect_left(ends, (span[2], 0))
    return ends[max(0, at - 4 - (span[2] - span[1])):at]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_task(crf: Crf) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = utf8(batch.column(1))
            for lo, hi in steps(raw):
                found = all_spans(crf, [t.decode("utf-8", "replace") for t in raw[lo:hi]])
                counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
                digest = [hashlib.sha256(_told(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(digest, pa.string()), pa.array([_told(every) for _, every in found], pa.string())],
                    names=[f.split()[0] for f in SCHEMA.split(", ")])
    return run


def find(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the pattern spans, and all spans of every row (columns of ``SCHEMA``)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy(_scan_task(crf)), SCHEMA)


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in every document."""
    return find(table(spark, sf_dir, "documents"), fit())
