"""Aligned tokens against brute force over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from catchwork.llm import alignment
from catchwork.llm.alignment import FOLDER, token_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")


def groups_of(encoders, text):
    """Groups of A and B ids of a whole text, encoded in one go; None where bytes differ."""
    a, b = encoders
    letters = alignment.byte_letters()
    sides = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, alignment.piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
        return None
    ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in sides]
    common = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in common]
    for side in (0, 1):
        g = 0
        for (i, _), end in zip(sides[side], ends[side], strict=True):
            while common[g] < end:
                g += 1
            out[g][side].append(i)
    return out


def brute(encoders, rows):
    links, groups = [], []
    for _, text in rows:
        found = groups_of(encoders, text) if text else None
        groups.append(found or [])
        links.append(Counter((x, y) for xs, ys in found or [] for x in xs for y in ys))
    counts = Counter(pair for x in links for pair in x)
    best: dict[int, int] = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = Counter()
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out[i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()), digest, sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items())] += 1
    return out


ODD = [
    "<|endoftext|> x", "a  b   c", "\n\n a b\t c", "é ö ß 你好 世界 ▁x", "<unk> <0x41> <s> </s>", "  x  y", "x" * 5000, "a\x00b", "﻿hi there", "é 가 ﬁ", "don't 's 'll  'x", "   ", "tab\t word\r\nline ",
    "🙂🙂 👩‍👩‍👧 x", "\x1c a \x85 b", "日本語テキスト" * 300, " a", " a b ", "a ", "1234567 89 0.5e10 -x", "y y y y y y y y y y", "​ 　  z",
]


def test_tokens(spark, docs, texts, encoders):
    rows = [*texts, *((100 + i, t) for i, t in enumerate(ODD)), (None, None), (200, ODD[1])]
    given = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, a int, block string").repartition(3)
    found = token_alignment(given)
    assert sorted(found.columns) == sorted(COLUMNS)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == brute(encoders, rows)


def test_small_blocks_and_memory(spark, encoders, monkeypatch):
    """Blocks, portions of pairs and the memory of pieces do not change results. Workers get the small sizes through the sweep's own arguments, so this part runs here."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "KNOWN_PIECES", 5)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 2)
    aligner = alignment.Aligner(f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model")
    r = random.Random(4)
    texts = [" ".join(r.choice(["pipe", "naïveté", "x9", "Straße", "don't"]) + str(r.randrange(30)) for _ in range(r.randrange(1, 60))) for _ in range(40)]
    for text in [*texts, *ODD]:
        block = alignment._Postings(7)
        row = block.add(aligner, pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})).to_pylist()[0]
        groups = groups_of(encoders, text) or []
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()))
        planes = [x for b in block.batches() for x in b.to_pylist()]
        found = Counter()
        for x in planes:
            assert x["words"] == [0] and x["bits"] == [1]
            found[x["a"], x["b"]] += 1 << max(0, x["plane"])
        assert found == links


def test_bitmaps():
    """Words of a bitmap that hold nothing are left out; the others hold the slots of the pair."""
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 5, 3000) << alignment.SLOT_BITS | r.integers(0, 4096, 3000) ** 2 % 4096)
    pairs, words, bits = alignment.bitmaps(keys)
    back = [int(p) << alignment.SLOT_BITS | 64 * w + j for p, ws, bs in zip(pairs, words.to_pylist(), bits.to_pylist(), strict=True) for w, b in zip(ws, bs, strict=True) for j in range(64) if b >> j & 1]
    assert back == keys.tolist()


def test_hot_pairs_and_no_rows(spark, encoders):
    rows = [(i, f"the same line {i % 3}") for i in range(300)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(120)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in token_alignment(given).collect()) == brute(encoders, rows)
    assert token_alignment(given.limit(0)).collect() == []
