import math
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import pii

from .test_operators import docs

PIECES = ["token", "ſecret", "apı_key", "APİ-KEY", "api-key", "passwd", "pwd", "access_key", '"', "'", " ", "\n", "\t", "      ", ":", "=", "@", ".", "-", "+", "(", ")", "/", "AKIA" + "B2" * 8, "ghp_" + "a1" * 12, "sk-" + "Z9" * 12, "0a" * 16, "DE89", "3704 ", "0044", "2", "34", "555", "٣٤", "７", "é", "x.y", "abcdefgh1234", "10.0.0.1", "fe80:", "1:2:3:4:5:6:7:8", "+1-2-34-56", "123-45-6789"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text("abk 1٣@.:=-+()", max_size=3)), max_size=14).map("".join))
def test_every_text_that_a_rule_matches_passes_the_first_test(text):
    if pii.entities(text):
        assert pii._hits(pa.array([text]))[0], text


@pytest.mark.parametrize("text", ['password      = "abcdefgh1234"', "token\n= abcdefgh1234", 'token"        = abcdefgh1234', "+1-2-34-56", "١٢٣-٤٥-٦٧٨٩", "apı_key: abcdefgh1234"])
def test_values_far_from_their_key_word_are_found(text):
    assert pii.entities(text) and pii._hits(pa.array([text]))[0]


def corpus(rng):
    out = []
    for i in range(120):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", f"w{i}"]) for _ in range(12)]
        if i % 3 == 0:
            words[4:4] = [f"p{i % 7}@mail.example.com"]
            words.insert(3, rng.choice(["contact", "Zebulon" if i % 7 == 0 else "reach", "Q7x"]))
        if i % 5 == 0:
            words.insert(8, f"10.0.0.{i}")
            words.insert(8, "server")
        out.append((i, " ".join(words)))
    return [*out, *out[:9], (500, "gamma <EMAIL> <TERM> beta"), (501, "<EMAIL> p1@mail.example.com gamma server contact")]


def test_disclosure_is_the_brute_force_one(spark):
    texts = corpus(random.Random(1))
    holds, near, has, values, seen_in, per_value, held = {}, {}, {}, {}, {}, {}, {}
    for _, t in texts:
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t)]
        for w in {w for *_, w in words}:
            has[w] = has.get(w, 0) + 1
        spans = pii.entities(t)
        for c in {c for *_, c in spans}:
            holds[c] = holds.get(c, 0) + 1
        for v in {(c, t[a:b]) for a, b, c in spans}:
            held[v] = held.get(v, 0) + 1
        outside = [(p, q, w) for p, q, w in words if not any(p < b and q > a for a, b, _ in spans)]
        by_class, by_value = set(), set()
        for a, b, c in spans:
            before = [i for i, (p, q, _) in enumerate(words) if q <= a][-pii.WINDOW :]
            after = [i for i, (p, q, _) in enumerate(words) if p >= b][: pii.WINDOW]
            for i in (*before, *after):
                if words[i] in outside:
                    by_class.add((c, words[i][2]))
                    by_value.add((c, t[a:b], words[i][2]))
        for c, w in by_class:
            near[c, w] = near.get((c, w), 0) + 1
        for c, v, w in by_value:
            values.setdefault((c, w), set()).add(v)
            seen_in.setdefault((c, v, w), set()).add(t)
            per_value[c, v, w] = per_value.get((c, v, w), 0) + 1

    def part(n, w, share):
        return 0.0 if share >= 1 else math.log(min(1.0, n / has[w]) / share) / -math.log(share)

    n = len(texts)
    want = {(c, None, w): part(k, w, holds[c] / n) for (c, w), k in near.items() if len(values[c, w]) >= pii.MIN_VALUES}
    want |= {(c, pii._value(v), w): part(k, w, held[c, v] / n) for (c, v, w), k in per_value.items() if len(seen_in[c, v, w]) >= pii.MIN_TEXTS}
    got = {(r["class"], r["value"], r["term"]): r["part"] for r in pii.disclosure(docs(spark, texts)).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_terms_are_applied_alike_by_broadcast_and_by_join(spark, monkeypatch):
    texts = corpus(random.Random(2)) + [(None, "p1@mail.example.com contact"), (7, None), (8, ""), (9, "contact p0@mail.example.com " + "word " * 30_000)]
    frame = docs(spark, texts)
    one = sorted(map(str, pii.sanitise(frame).collect()))
    monkeypatch.setattr(pii, "TERMS_AT_ONCE", 0)
    monkeypatch.setattr(pii, "TEXT_ROWS", 0)
    two = sorted(map(str, pii.sanitise(frame).collect()))
    assert one == two and len(one) == len(texts)
    by = {r["doc_id"]: r for r in pii.sanitise(frame).collect()}
    assert any("<TERM>" in r["text"] or r["pii_terms"] for i, r in by.items() if i is not None and i < 120)
    # a placeholder that a text already has is no entity and is not rewritten
    assert by[500]["text"] == "gamma <EMAIL> <TERM> beta" and by[500]["pii_entities"] == 0


def test_kinds_of_generalised_words():
    said = {"email": {"zebulon": False, "q7x": False, "1984": False, "plain": False, "gone": True}}
    text = "Zebulon Q7x 1984 plain gone a@b.example rest"
    assert pii._rewrite(text, {"EMAIL": said["email"]})[0] == "<NAME> <CODE> <NUMBER> <TERM> <EMAIL> rest"
    assert pii._rewrite(text, {"IP": said["email"]})[0] == "Zebulon Q7x 1984 plain gone <EMAIL> rest"
    # removal by the one outweighs a general term by the other
    assert pii._rewrite("plain a@b.example", {"EMAIL": {"plain": False}}, {"plain": True})[0] == "<EMAIL>"
