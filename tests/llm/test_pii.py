import hashlib
import re

import numpy as np
import pytest

from loomstat.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = [("card", CARD, lambda d: 12 <= len(d) <= 19 and P.luhn(d)), ("phone", PHONE, lambda d: 9 <= len(d) <= 15)]
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, good in digits:
        out += [(kind, *m.span()) for m in pattern.finditer(text) if good(re.sub("[^0-9]", "", m[0]))]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def crf():
    return P.fit()


HARD = ["a@b.c@d.e", "@x.y", "x@", "a@b", "a@b.", "a..b@c.d.e-", "x@y.z,w@v.u", "1.2.3.4.5", "256.1.1.1 0001.02.3.4",
        "1..2.3.4.5", "4111 1111-1111 1111 2", "+1 (212) 555-0147 1", "+1", "+1+2+3456789012", "4111111111111111",
        "é4111111111111111é +49 30 901820", "", "a.b@c.d" * 3, "1" * 5000, "1." * 3000, "a" * 5000 + "@", "0" * 16]


def test_patterns_against_plain_regular_expressions(spark, sf):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert P.base_spans(t) == brute(t), t[:80]


def test_patterns_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 200_000, "@" * 300_000, "+1" * 200_000):
        P.base_spans(t)


def test_viterbi_against_all_paths(crf):
    from itertools import product
    rng = np.random.default_rng(2)
    runs = [rng.normal(size=(n, len(P.STATES))) for n in (1, 2, 3, 4, 4, 2)]
    for run, got in zip(runs, crf.decode(runs)):
        def score(path):
            return sum(run[i, s] for i, s in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
        assert tuple(got) == max(product(range(len(P.STATES)), repeat=len(run)), key=score)


def test_field_learns_its_lines_and_generalises():
    lines = P.labelled_lines(P.LABELLED)
    right = total = 0
    for fold in range(4):
        crf = P.Crf().train([x for i, x in enumerate(lines) if i % 4 != fold])
        for tokens, tags in lines[fold::4]:
            right += sum(a == b for a, b in zip(crf.decode([crf.emissions(tokens)])[0], tags))
            total += len(tags)
    assert right / total > 0.9


def test_field_adds_and_keeps(crf):
    for text, want in {"call (415) 555-9832 now": ("phone", 5, 19), "mail josé@correo.example": ("email", 5, 24),
                       "Des +1 (826) 555-4081 190.137.223.20": ("phone", 4, 21)}.items():
        base, every = P.all_spans(crf, [text])[0]
        assert want in every and want not in base
    for text in ("in 1998 there were 12", "on 2021-03-04", "version 1.2.3", "plain words only", "1939-1945"):
        assert P.all_spans(crf, [text])[0] == ([], [])


def test_query(spark, sf, odd_docs, no_docs, crf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op7_pii_crf(spark, sf).collect():
        base = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in P.KINDS)
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(",")) | {""}
    out = P.find(odd_docs, crf).collect()
    assert len(out) == 12 and all(r.spans == "" for r in out if r.doc_id in (3, 4, 5))
    assert P.find(no_docs, crf).count() == 0


@pytest.mark.parametrize("n", [0, 1, 10, 60, 61, 62, 63, 64, 70, 5000])
def test_runs_of_any_length(crf, n):
    text = "12 " * n + "(212) 555-0147"
    base, every = P.all_spans(crf, [text])[0]
    assert every == [("phone", 3 * n, 3 * n + 14)] and base == []


def test_long_runs_are_decoded_as_short_ones(crf, monkeypatch):
    rng = np.random.default_rng(5)
    runs = [rng.normal(size=(int(n), len(P.STATES))) for n in (*rng.integers(1, 90, 40), 700)]
    want = crf.decode(runs)
    monkeypatch.setattr(P, "DECODE_TOKENS", 50)
    assert all((a == b).all() for a, b in zip(crf.decode(runs), want))


def test_context_and_long_tokens(crf):
    cue = P.all_spans(crf, ["tel 07700 900123"])[0][1]
    far = P.all_spans(crf, ["tel" + " " * 400 + "07700 900123"])[0][1]
    assert [(k, b - a) for k, a, b in far] == [(k, b - a) for k, a, b in cue] == [("phone", 12)]
    assert P.features("a1" * 40) == [*P.features("a1" * 32), "long"]
    assert P.all_spans(crf, ["x " + "9f8c2e7a" * 30 + " y"])[0] == ([], [])


def held_out_lines(n=400):
    """Marked lines of other wordings and numbers than the labelled table's."""
    rng = np.random.default_rng(31)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    phones = [lambda: f"({rng.integers(200, 999)}) {d(3)}-{d(4)}", lambda: f"{rng.integers(200, 999)}-{d(3)}-{d(4)}",
              lambda: f"01{rng.integers(10, 99)} 496 {d(4)}", lambda: f"07{d(3)} {d(6)}", lambda: f"(0{rng.integers(20, 99)}) {d(3)}-{d(4)}"]
    emails = [lambda: f"{d(2)}zoë@haus.test", lambda: f"kim{d(3)}(at)mail.example", lambda: f"root@host{d(2)}", lambda: f"a.b[at]c{d(1)}.test"]
    says = ["please call {} before noon", "my phone: {}", "ring {} or come by", "new mobile {} since May", "you can phone {} today"]
    plain = [lambda: f"in {rng.integers(1500, 2030)} and {rng.integers(1500, 2030)}", lambda: f"version {d(1)}.{d(2)}.{d(1)} of it",
             lambda: f"on 20{d(2)}-0{rng.integers(1, 9)}-1{d(1)} at 1{d(1)}:{rng.integers(10, 59)}", lambda: f"part {d(3)} {d(4)} {d(3)}",
             lambda: f"pages {rng.integers(1, 400)}-{rng.integers(400, 900)}", lambda: f"about {d(2)} {d(3)} people", lambda: f"serial {d(4)} {d(4)} {d(3)}",
             lambda: f"the {rng.integers(1, 30)}th, (1) and (2)", lambda: f"id {d(2)}f{d(3)}c", lambda: f"a sum of {d(4)}.{d(2)} or {d(2)} %"]
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            out.append(rng.choice(says).format("{phone:" + phones[rng.integers(len(phones))]() + "}"))
        elif kind == 1:
            out.append(rng.choice(["write to {}", "mail {} soon", "from {} only"]).format("{email:" + emails[rng.integers(len(emails))]() + "}"))
        else:
            out.append(plain[rng.integers(len(plain))]())
    return out


def test_precision_and_recall_of_spans(crf):
    right = found = wanted = 0
    for line in held_out_lines():
        text, want, at = "", set(), 0
        for m in P._MARK.finditer(line):
            text += line[at:m.start()]
            want.add((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        text += line[at:]
        got = set(P.all_spans(crf, [text])[0][1])
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    print("precision", right / found, "recall", right / wanted)
    assert right / found >= 0.9 and right / wanted >= 0.9


def test_clashing_columns(spark, odd_docs, crf):
    names = ["doc_id", "text", "n_email", "spans", "base_sha256", "_id", "pos", "kind"]
    out = P.find(odd_docs.toDF(*names), crf)
    assert out.columns == [f.split()[0] for f in P.SCHEMA.split(", ")] and out.count() == 12
