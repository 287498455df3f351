import random

import numpy as np
import pytest

from codestrata.llm import licenses
from codestrata.llm.license_texts import TEMPLATES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_nearest_stretch_is_the_brute_force_one():
    rng = random.Random(4)
    for _ in range(60):
        t = [rng.randrange(5) for _ in range(rng.randint(1, 7))]
        b = [rng.randrange(5) for _ in range(rng.randint(0, 12))]
        want = min(edits(t, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        got, i, j = licenses.nearest_stretch(np.array(t), np.array(b, np.int64))
        assert got == want == edits(t, b[i:j])


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_reworded_licences_are_found_with_their_differences(name):
    """Every template with changed, extra and missing words within what is allowed, against the edit distance."""
    rng = random.Random(name)
    words = licenses.words_of(TEMPLATES[name])
    allowed = int(licenses.TOLERANCE * len(words))
    text = list(words)
    for k in rng.sample(range(3, len(words)), min(allowed // 2, 12)) if len(words) > 12 else []:
        text[k] = rng.choice(["zyx", text[k] + " qrs", "ok"])
    lines = "Copyright 2020 Someone\n" + "\n".join(" ".join(text[a : a + 11]) for a in range(0, len(text), 11))
    got = {r[1]: r for r in licenses.Scanner(TEMPLATES).confirm(*licenses.blocks_of("some words before\n" + lines + "\nint main"))}
    assert name in got
    if len(words) < 300:
        assert got[name][4] == edits(words, licenses.words_of(" ".join(text)))


def test_a_whole_licence_is_told_from_its_kin():
    for name in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "apache-2.0", "mpl-2.0", "bsd-3-clause", "bsd-2-clause"):
        found = [(r[1], r[4]) for r in licenses.Scanner(TEMPLATES).confirm(*licenses.blocks_of(TEMPLATES[name]))]
        assert (name, 0) in found
        assert not {n for n, _ in found} & ({"gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "apache-2.0", "mpl-2.0", "bsd-3-clause", "bsd-2-clause"} - {name})


def test_a_changed_second_half_is_not_exact():
    half = TEMPLATES["bsd-2-clause"].replace("EVEN IF ADVISED", "UNLESS ADVISED")
    (row,) = [r for r in licenses.Scanner(TEMPLATES).confirm(*licenses.blocks_of(half)) if r[1] == "bsd-2-clause"]
    assert row[4] == 2 and "unless" in row[6]


def test_regions_hold_every_near_stretch():
    rng = random.Random(6)
    for _ in range(400):
        t = np.array([rng.randrange(9) for _ in range(rng.randint(4, 9))])
        block = np.array([rng.randrange(14) for _ in range(rng.randint(0, 40))], np.int64)
        if rng.random() < 0.7 and len(block):
            at = rng.randrange(len(block))
            block = np.concatenate((block[:at], t[: rng.randint(3, len(t))], block[at:]))
        allowed = rng.randint(0, 2)
        held = licenses.regions(t, block, allowed)
        whole = licenses.nearest_stretch(t, block)
        if whole[0] <= allowed:
            assert min(licenses.nearest_stretch(t, block[p:q])[0] for p, q in held) == whole[0]
        assert all(q < p for (_, q), (p, _) in zip(held, held[1:]))
