"""Personal data: the base rules against plain expressions, bootstrapping, awkward rows."""

import math
import random
import re
import time

import pytest

from usagelens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    out = []
    for kind, rule in PLAIN.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and pii._luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if fits:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_rules():
    rng = random.Random(31)
    for _ in range(20000):
        text = "".join(rng.choices("a@.-0125 +()%\n1123@.Ü", k=rng.randint(0, 60)))
        assert pii.base_spans(text) == _plain(text), text
    assert pii._luhn("4111111111111111") and not pii._luhn("4111111111111112")


def test_long_runs_are_quick():
    text = "a" * 300000 + "@" * 20000 + "1" * 300000 + "+1" * 20000 + "1.1." * 20000
    assert isinstance(pii.loose_spans(text, pii.base_spans(text)), list)


def test_patterns_discover_unseen_forms(make_docs):
    """Loose forms in the place of seeds are found; the same forms elsewhere are not."""
    rows = []
    for i in range(40):
        rows.append((i, f"please write to user{i}@mail.org for more of number {i}"))
    rows += [
        (100, "please write to jane [at] home [dot] net for more of it"),
        (101, "the odd joe [at] home [dot] net was elsewhere"),
    ]
    out = {r["doc_id"]: r for r in pii.extracted(make_docs(rows)).collect()}
    text = dict(rows)[100]
    span = out[100]["spans"][0]
    assert text[span["start"] : span["end"]] == "jane [at] home [dot] net"
    assert not out[100]["base"] and not out[101]["spans"]
    assert all(len(out[i]["base"]) == len(out[i]["spans"]) == 1 for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(make_docs(rows)).collect()}
    assert clean[100] == "please write to [EMAIL] for more of it"
    assert clean[101] == dict(rows)[101]
    assert clean[3] == "please write to [EMAIL] for more of number 3"


def _two_steps():
    """Contexts of seeds, a context that only loose forms of the first share, and strangers."""
    rows = [(i, f"please write to user{i}@mail.org for more of it") for i in range(40)]
    for i in range(8):
        rows.append((100 + i, f"please write to p{i} [at] home [dot] net for more of it"))
        rows.append((200 + i, f"then ping p{i} [at] home [dot] net via chat today"))
    rows += [
        (300, "then ping zoe at nowhere dot com via chat today"),
        (301, "then ping joe@intranet via chat today"),
        (302, "then ping version7 via chat today"),
        (303, "they met zoe at somewhere dot com again, joe@extranet too"),
    ]
    rows += [(400 + i, f"call me at +1 555 010 {1000 + i} before noon") for i in range(20)]
    rows += [(500, "call me at 5551234567 before noon"), (501, "item 5551234568 is sold out")]
    return rows


def test_believed_instances_induce_patterns(make_docs):
    rows = _two_steps()
    text = dict(rows)
    found = {
        r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]]
        for r in pii.extracted(make_docs(rows)).collect()
    }
    assert all(found[200 + i] == [f"p{i} [at] home [dot] net"] for i in range(8))
    assert found[300] == ["zoe at nowhere dot com"] and found[301] == ["joe@intranet"]
    assert found[500] == ["5551234567"]
    assert not found[302] and not found[303] and not found[501]


def test_beliefs_equal_a_plain_loop(make_docs):
    docs = make_docs(_two_steps() * 2)
    rows = pii.found(docs)
    edges = {}
    for r in rows.collect():
        for m in r["mentions"]:
            for p in m["patterns"]:
                edges[m["kind"], p, m["instance"]] = m["seed"]
    belief = {}
    for _ in range(pii.ROUNDS):
        trust = {}
        for kind, pattern in {e[:2] for e in edges if e[0] != "other"}:
            here = [(k, i, s) for (k, p, i), s in edges.items() if p == pattern]
            scores = [1 if s else belief.get((k, i), 0) for k, i, s in here if k == kind]
            if sum(x >= pii.BELIEVED for x in scores) >= pii.SUPPORT:
                trust[kind, pattern] = sum(scores) / len(here)
        doubt = {}
        for (kind, pattern, instance), seed in edges.items():
            share = trust.get((kind, pattern), 0)
            if not seed and share >= pii.TRUSTED:
                key = kind, instance
                doubt[key] = doubt.get(key, 1) * (1 - min(share, 0.999))
        belief = {key: 1 - x for key, x in doubt.items()}
    out = {(r["kind"], r["instance"]): r["belief"] for r in pii.beliefs(rows).collect()}
    assert out.keys() == belief.keys() and len(out) >= 11
    assert all(math.isclose(out[k], belief[k], abs_tol=1e-9) for k in out)


@pytest.mark.parametrize("piece", ["mail a@b.org now ", "call 5551234567 x ", "1 a@", "a at b ", "@", "a.b-"])
def test_time_grows_with_the_length_only(piece):
    text = piece * (1_000_000 // len(piece))
    begun = time.time()
    pii.loose_spans(text, pii.base_spans(text))
    assert time.time() - begun < 20


def test_clashing_names(make_docs):
    docs = make_docs([(1, "mail a@b.org now")]).selectExpr(
        "*", "7 AS pii_id", "8 AS pii_key", "9 AS pii_spans", "10 AS PII_TEXT"
    )
    row = pii.redacted(docs).first()
    assert row["text"] == "mail [EMAIL] now"
    assert (row["pii_id"], row["pii_key"], row["pii_spans"], row["PII_TEXT"]) == (7, 8, 9, 10)


def test_awkward_rows(awkward, make_docs):
    rows = pii.digests(pii.extracted(awkward)).collect()
    assert len(rows) == awkward.count()
    texts = {d["doc_id"]: d["text"] or "" for d in awkward.collect()}
    for r in rows:
        spans = _plain(texts[r["doc_id"]])
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    clean = pii.redacted(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    by_id = {r["doc_id"]: r for r in clean.collect()}
    assert by_id[20]["text"] is None and by_id[20]["n_chars"] is None
    assert by_id[26]["text"].startswith("mail [EMAIL] ") and by_id[26]["text"].endswith("[PHONE]")
    assert by_id[26]["n_chars"] == len(by_id[26]["text"])
    assert pii.extracted(make_docs([])).count() == 0
