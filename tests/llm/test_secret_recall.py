"""Random strings that must be found however long they are, repeated or beside each other."""

from __future__ import annotations

import string

import numpy as np

from catchwork.llm import secrets

MIXED, LOWER, UPPER_HEX = string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, "0123456789ABCDEF"


def token(r, n, alphabet=MIXED):
    return "a1A1"[: 2 if alphabet == LOWER else 4].replace("a", "A" if alphabet == UPPER_HEX else "a") + "".join(alphabet[i] for i in r.integers(0, len(alphabet), n - (2 if alphabet == LOWER else 4)))


def share(spark, texts_and_values):
    """Which share of the values lies within a cut span."""
    rows = [(i, t) for i, (t, _) in enumerate(texts_and_values)]
    cut = {r.doc_id: r.cut for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [(i, at, at + len(v)) for i, (t, values) in enumerate(texts_and_values) for v in values for at in [k for k in range(len(t)) if t.startswith(v, k)]]
    return sum(any(c.start <= a and z <= c.end for c in cut[i]) for i, a, z in want) / len(want)


def test_a_token_stated_twice(spark):
    r = np.random.default_rng(1)
    cases = [(f"the bearer {v} was sent\nthe bearer {v} was sent again", [v]) for v in (token(r, 24) for _ in range(30))]
    assert share(spark, cases) == 1


def test_neighbouring_tokens_of_copied_texts(spark):
    r = np.random.default_rng(2)
    cases = []
    for n in (24, 40, 64):
        for _ in range(20):
            v, w = token(r, n), token(r, n)
            cases += [(f"auth user {v} and bearer {w} end", [v, w])] * 3
    assert share(spark, cases) > 0.98


def test_long_tokens(spark):
    r = np.random.default_rng(3)
    for alphabet in (MIXED, LOWER, UPPER_HEX):
        for n in (24, 40, 64, 88, 128, 256, 1024, 4000):
            found = share(spark, [(f"The credential {v} is kept by the office for later use", [v]) for v in (token(r, n, alphabet) for _ in range(20))])
            print(len(alphabet), n, found)
            assert found >= 0.95


def test_private_key_block(spark):
    r = np.random.default_rng(4)
    body = "\n".join([token(r, 64) for _ in range(12)] + ["Ab3+9w=="])
    assert share(spark, [(f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----\nmore", [body]) for kind in ("", "RSA ")]) == 1


def test_long_identifiers_are_not_novel(spark):
    names = [f"The session configuration_of_the_{w}_connection_manager_for_incoming_requests_{i}" for i, w in enumerate(("first", "second", "other", "remote"))]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).collect()
    assert all(r.n_novel == 0 for r in rows)
