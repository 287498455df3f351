import json
import random
import time

import numpy as np
import pytest

from codestrata.llm import wrappers


def brute_fold(keys):
    """The same folds by trying every period from the shortest."""
    items = [[k, [i]] for i, k in enumerate(keys)]
    names = list(keys)
    while True:
        for period in range(1, len(names) // 2 + 1):
            same = [names[i] == names[i + period] for i in range(len(names) - period)]
            at, out, out_names, folded = 0, [], [], False
            while at < len(names):
                run = 0
                while at + run < len(same) and same[at + run]:
                    run += 1
                if run >= period and (period > 1 or names[at][0] == "*" or names[at] == "#"):
                    count = run // period + 1
                    body = [wrappers._zip_items([items[at + r * period + k] for r in range(count)]) for k in range(period)]
                    out.append(["*", body, count])
                    out_names.append("*(" + " ".join(names[at : at + period]) + ")")
                    at += count * period
                    folded = True
                else:
                    out.append(items[at])
                    out_names.append(names[at])
                    at += 1
            if folded:
                items, names = out, out_names
                break
        else:
            return items


def test_folds_are_those_of_every_period():
    rng = random.Random(1)
    for n in range(700):
        alphabet = ["a", "/a", "#", "b", "c", "d"][: rng.randint(1, 6)]
        part = [rng.choice(alphabet) for _ in range(rng.randint(1, 14))]
        keys = [rng.choice(alphabet) for _ in range(rng.randint(0, 10))] + part * rng.randint(0, 4) + [rng.choice(alphabet) for _ in range(rng.randint(0, 10))] + part[:7] * rng.randint(0, 3)
        got, want = wrappers.fold_repeats(keys), brute_fold(keys)
        assert got == want, keys


def lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_common_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(wrappers, "LCS_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 30))] for _ in "xy")
        pairs = wrappers.common(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_long_pages_align_in_seconds():
    rng = random.Random(2)
    records = [[[f"p.c{rng.randrange(90)}", 0, None], ["#", 0, None], ["/p", 0, None]] for _ in range(2000)]
    left, right = sum(records, []), sum((r for r in records if rng.random() > 0.1), [])
    began = time.perf_counter()
    merged = wrappers.merge(left, right, [0])
    assert time.perf_counter() - began < 4 and len(merged) == len(left)
    began = time.perf_counter()
    wrappers.fold_repeats([rng.choice(["div", "/div", f"c{i % 700}"]) for i in range(40_000)])
    assert time.perf_counter() - began < 30


def planted(rng, fields, lists, optional):
    """A random template, and a function that fills it: (html, its field texts in order)."""
    tags = [f"<div class='k{k}'>" for k in range(30)]
    parts = []
    for k in range(fields):
        parts.append(("field", f"{rng.choice(tags)}<h{k % 6} id='f{k}'>", f"</h{k % 6}></div>"))
        parts.append(("text", f"<p class='s{k}'>", f"label {k}</p>"))
    for k in range(lists):
        parts.append(("list", f"<ul class='l{k}'>", "".join(f"<b class='i{k}-{j}'>%s</b>" for j in range(rng.randint(1, 25)))))
    for k in range(optional):
        parts.append(("maybe", f"<aside class='o{k}'>", f"<i class='x{k}'>%s</i></aside>"))
    rng.shuffle(parts)

    def fill(n):
        html, want = "<html><body>", []
        for k, (kind, a, b) in enumerate(parts):
            if kind == "field":
                want.append(f"value {n} {k}")
                html += a + want[-1] + b
            elif kind == "text":
                html += a + b
            elif kind == "list":
                html += a
                for r in range(1 + n % 4):
                    got = [f"item {n} {k} {r} {j}" for j in range(b.count("%s"))]
                    html += b % tuple(got)
                    want += got
                html += "</ul>"
            elif (n + k) % 3:
                want.append(f"extra {n} {k}")
                html += a + b % want[-1]
        return html + "</body></html>", want

    return fill


@pytest.mark.parametrize("seed", range(3))
def test_planted_fields_are_extracted_and_labels_are_not(spark, monkeypatch, seed):
    """Pages of random templates: all filled-in texts, and only those, are content; a slot holds one field of the template."""
    monkeypatch.setattr(wrappers, "PART", 3)
    rng = random.Random(seed)
    rows, want = [], {}
    for host in range(4):
        fill = planted(rng, rng.randint(1, 8), rng.randint(0, 3), rng.randint(0, 4))
        for n in range(24):
            html, texts = fill(n)
            rows.append((len(rows), f"http://h{host}/{n}", html, "clash", "clash"))
            want[rows[-1][0]] = texts
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, wrapper string, template_pages string")
    got = {r["page_id"]: r for r in wrappers.extract(frame).collect()}
    assert all(got[i]["content"].split("\n") == want[i] for i in want)
    for host in range(4):
        by_slot = {}
        for i in range(24 * host, 24 * host + 24):
            for f in got[i]["fields"]:
                kind, _, k, *rest = f["text"].split()
                by_slot.setdefault(f["slot"], set()).add((kind, k, rest[1] if rest else None))
        by_slot.pop(-1, None)
        assert all(len(s) == 1 for s in by_slot.values()), by_slot
    monkeypatch.setattr(wrappers, "WRAPPER_BYTES", 0)
    assert {r["page_id"]: r for r in wrappers.extract(frame).collect()} == got


def test_wrappers_do_not_depend_on_order_or_parts_of_one(spark, monkeypatch):
    rng = random.Random(9)
    fill = planted(rng, 3, 1, 2)
    rows = [(n, "http://h/x", fill(n)[0]) for n in range(20)]
    frames = [spark.createDataFrame(rng.sample(rows, len(rows)), "page_id bigint, url string, html string") for _ in "ab"]
    a, b = ([tuple(r) for r in wrappers.infer(f).collect()] for f in frames)
    assert a == b and a[0][2] == 20 and "|" not in a[0][3] and json.loads(a[0][1])
