"""Edit distances by bit vectors, against the full table."""

import random
import time

from quillmask.functions import edits
from quillmask.operators.evaluate import near_places

from test_fixtures import edits as plain


def test_distance():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc😀") for _ in range(rng.randrange(0, 90))) for _ in "ab")
        assert edits.distance(a, b) == plain(a, b)


def test_windows_by_brute_force():
    rng, hits = random.Random(2), 0
    for _ in range(60):
        letters, n = rng.choice(["ab", "abcdefgh", "é😀 "]), rng.choice([1, 10, 20, 63, 64, 65, 130])
        value, text = ("".join(rng.choice(letters) for _ in range(k)) for k in (n, rng.randrange(0, 400)))
        if rng.random() < 0.7:
            own = list(value)
            for _ in range(rng.randrange(0, n // 4 + 1)):
                own[rng.randrange(n)] = rng.choice(letters)
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "".join(own) + text[at:]
        size, most = n + 4, rng.randrange(4, 5 + n // 3)
        want = [p for p in range(len(text) - size + 1) if plain(value, text[p : p + size]) <= most]
        assert list(edits.close_windows(text, value, size, most)) == want
        hits += len(want)
    assert hits > 500


def test_a_long_value_in_a_long_text():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(1_000_000))
    own = list(text[900_000:900_200])
    own[::9] = "Q" * len(own[::9])
    began = time.time()
    near = near_places(text, "".join(own))
    assert len(near) == 3 and all(x in text[899_900:900_300] for x in near) and time.time() - began < 1
