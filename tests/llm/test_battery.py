"""The battery and its false discovery control against plain Python, and what they find of planted strings."""

from __future__ import annotations

import math
import random
import re

import pytest

from tessera.llm import secrets

ALPHABETS = {name: letters for name, _, letters in secrets.ENCODINGS}
PLANTED = [("base62", 20), ("base62", 24), ("base62", 32), ("base62", 40), ("base64", 40), ("base36", 32), ("base32", 32), ("base32", 40), ("hex", 24), ("HEX", 32)]
WORDS = "the model config of large batches with size and adam learning rate from local path to user share python site packages report final version draft notes monday release".split()


def upper_tail(z):
    x = abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = math.exp(-x * x / 2) * 0.3989422804014327 * poly
    return tail if z >= 0 else 1 - tail


def serial(x):
    m = sum(x) / len(x) if x else 0
    own = sum((v - m) ** 2 for v in x)
    return sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / own if own > 1e-9 else None


def plain(token):
    """(length, whether randomness isn't rejected, p-value under text)."""
    letters = next(letters for _, pattern, letters in secrets.ENCODINGS if re.search(pattern, token))
    body = token.rstrip("=")
    x, k, n = [letters.find(c) for c in body], len(letters), len(body)
    squares = sum(x.count(v) ** 2 for v in set(x))
    df, chi = k - 1, max(k / n * squares - n, 1e-9)
    p_uniform = upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [v * 2 >= k for v in x]
    n1 = sum(high)
    mean = 1 + 2 * n1 * (n - n1) / n
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    p_runs = 2 * upper_tail(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    r = serial(x)
    p_serial = 2 * upper_tail(abs((1.0 if r is None else r) + 1 / n) * math.sqrt(n))
    t1 = upper_tail(2 * (math.sqrt(secrets.TEXT_REPEATS * n * (n - 1) / 2) - math.sqrt((squares - n) / 2 + 0.375)))
    solid = re.sub("[A-Z](?=[a-z])", "a", re.sub("[^A-Za-z0-9]", "", body))
    c = [1 if s.islower() else 2 if s.isupper() else 3 for s in solid]
    m, q = len(c), secrets.TEXT_CHANGES
    t2 = upper_tail((sum(a != b for a, b in zip(c, c[1:])) - 0.5 - (m - 1) * q) / math.sqrt((m - 1) * q * (1 - q))) if m > 1 else 1.0
    r = serial(c)
    t3 = 1.0 if r is None else upper_tail((secrets.TEXT_SERIAL - r) * math.sqrt(m))
    half = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (t1, t2, t3))
    return n, min(p_uniform, p_runs, p_serial) * 3 >= secrets.ALPHA, math.exp(-half) * (1 + half + half * half / 2)


def discoveries(tokens):
    """Benjamini-Hochberg by class of length over the p-values' steps."""
    tested = {t: plain(t) for t in tokens}
    step = lambda p: min(math.floor(-math.log10(max(p, 1e-300)) * secrets.STEPS), secrets.DEEPEST)
    kind = lambda n: min(math.floor(math.log2(n)), 12)
    found = set()
    for length in {kind(n) for n, *_ in tested.values()}:
        mine = [t for t in tokens if kind(tested[t][0]) == length]
        steps = [step(tested[t][2]) for t in mine]
        good = [s for s in set(steps) if 10 ** (-s / secrets.STEPS) <= secrets.FDR * sum(x >= s for x in steps) / len(steps)]
        found |= {t for t, s in zip(mine, steps) if good and s >= min(good) and tested[t][1]}
    return found


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(11)
    planted = {(kind, n): ["".join(rng.choices(ALPHABETS[kind], k=n)) for _ in range(20)] for kind, n in PLANTED}
    text = set()
    while len(text) < 600:
        w = rng.choices(WORDS, k=rng.randint(4, 9))
        text.add({0: "-".join(w), 1: "/usr/" + "/".join(w), 2: "".join(x.capitalize() for x in w), 3: "_".join(w) + f"_{rng.randint(1, 99)}", 4: "".join(w)}[rng.randint(0, 4)])
    text |= {"ModelConfigV2LargeBatchSize512Adam", "2024-01-15-release-notes-final", "AbstractSingletonProxyFactoryBean", "=" * 40, "_" * 30, "0" * 25}
    text = sorted(t for t in text if len(t) >= secrets.LEAST)
    every = text + [t for v in planted.values() for t in v]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in enumerate(every)], "doc_id long, text string")
    rows = secrets.scan(docs).collect()
    got = {every[r["doc_id"]] for r in rows if any(s["kind"] == "random" for s in r["spans"])}
    base = {every[r["doc_id"]] for r in rows if r["base"]}
    return planted, text, every, got, base


def test_is_plain_python(found):
    *_, every, got, base = found
    # base spans take their part of a candidate away; all others are candidates as they stand
    assert got - base == discoveries([t for t in every if t not in base and len(t.rstrip('=')) >= secrets.LEAST])


def test_recall_and_precision(found):
    planted, text, _, got, base = found
    share = {k: sum(t in got or t in base for t in v) / len(v) for k, v in planted.items()}
    print({f"{k[0]}:{k[1]}": v for k, v in share.items()}, [t for t in text if t in got])
    assert min(share.values()) >= 0.7 and sum(share.values()) / len(share) >= 0.9
    assert sum(t in got for t in text) <= 0.02 * len(text)
