import itertools
import random
import re

import numpy as np

from driftspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append(pii.Span(kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s.start, pii.KINDS.index(s.kind)))


def test_base_spans_match_the_patterns():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("1234a@.. -+()é") for _ in range(rnd.randint(1, 50))) for _ in range(20_000)]
    texts += ["a@b.c.@d.e x@y", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111-1111 1111 1111", "+1 (555) 123-4567."]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" * 150_000, "a@" * 150_000, "1." * 150_000, "+1" + "(" * 300_000):
        pii.find([text], pii.default_model())


def test_viterbi_finds_the_best_path():
    rnd = np.random.default_rng(1)
    k = len(pii.TAGS)
    transition = np.where(pii._allowed(), rnd.normal(size=(k + 1, k)), pii.FORBIDDEN)
    scores = rnd.normal(size=(3, 4, k))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    path = pii.viterbi(scores, mask, transition)
    for n in range(3):
        length = int(mask[n].sum())

        def value(tags, n=n):
            return sum(scores[n, t, y] + transition[tags[t - 1] if t else k, y] for t, y in enumerate(tags))

        best = max(itertools.product(range(k), repeat=length), key=value)
        assert tuple(path[n, :length]) == best


def test_labelled_table_is_learned_and_held_out_lines_are_found():
    model = pii.fit(pii.EXAMPLES[::2] + pii.EXAMPLES[1::4])
    right = total = 0
    for line in pii.EXAMPLES[3::4]:
        text = re.sub(r"\[\w+:([^\]]*)\]", r"\1", line)
        wanted = re.findall(r"\[(\w+):([^\]]*)\]", line)
        base, more = pii.find([text], model)[0]
        got = [(s.kind, text[s.start : s.end]) for s in [*base, *more]]
        right += sorted(got) == sorted(wanted)
        total += 1
    assert right / total > 0.8


def test_operator_and_redaction(make_docs):
    rows = [
        (1, "mail a.b@c.example.org or call (555) 867-5309, é +1 (555) 234-5678 now"),
        (2, None), (3, ""), (None, "the host 10.0.0.1 and card 4111 1111 1111 1111"), (4, "plain words only"),
        (4, "plain words only"),
    ]
    docs = make_docs(rows, ["spans", "found"])
    found = pii.with_spans(docs, "all_spans").collect()
    first = found[0]
    assert [(s.kind, rows[0][1][s.start : s.end], s.base) for s in first.all_spans] == [
        ("email", "a.b@c.example.org", True), ("phone", "(555) 867-5309", False), ("phone", "+1 (555) 234-5678", True),
    ]
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    assert [r.text for r in redacted.collect()] == [
        "mail <EMAIL> or call <PHONE>, é <PHONE> now", None, "", "the host <IP> and card <CARD>",
        "plain words only", "plain words only",
    ]
    assert pii.redact(make_docs([])).count() == 0
