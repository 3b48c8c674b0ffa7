from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter

import xxhash

from textloom.llm.fingerprints import SAMPLES, compared, fingerprints

from .helpers import docs, none, odd, odd_rows, words


def alike(a: str, b: str) -> float:
    x, y = Counter(words(a)), Counter(words(b))
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def edited(a: str, b: str) -> str:
    c = len(a) // 4
    return a[: len(a) - c] + b[:c]


def test_contract(spark):
    rows = sorted((r.doc_id, r.text or "") for r in docs(spark).collect())
    found = {r.doc_id: r for r in compared(docs(spark)).collect()}
    assert len(found) == len(rows)
    marks, off, near = {}, [], []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        own = edited(text, after)
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * SAMPLES * bool(words(text))
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint and marks.setdefault(own, r.edited_fingerprint) == r.edited_fingerprint
        off.append(r.near_edited - alike(text, own))
        near.append(r.near_next - alike(text, after))
    # an unbiased estimate: of n samples the deviation is at most 1 / sqrt(4 n)
    for x in (off, near):
        assert abs(sum(x) / len(x)) < 0.02
        assert (sum(v * v for v in x) / len(x)) ** 0.5 < 0.6 / SAMPLES**0.5


def test_odd_rows(spark):
    found = compared(odd(spark)).collect()
    assert len(found) == len(odd_rows())
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by[4].fingerprint == by[5].fingerprint == by[7].fingerprint != by[6].fingerprint
    assert by[1].fingerprint == by[2].fingerprint == "" and by[1].near_next == 1.0 and by[3].near_next == 0.0
    assert by[4].near_next == 1.0
    one = {r.doc_id: r.fingerprint for r in fingerprints(odd(spark)).collect() if r.doc_id is not None}
    assert all(one[i] == by[i].fingerprint for i in one)
    assert compared(none(spark)).count() == 0 and fingerprints(none(spark)).count() == 0
    single = compared(odd(spark).where("doc_id = 8")).collect()
    assert [r.near_next for r in single] == [1.0]


def test_no_python_in_the_plan(spark):
    for df in (compared(docs(spark)), fingerprints(docs(spark))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def _hash(*values, seed: int = 42) -> int:
    """xxhash64 of columns in turn: strings as UTF-8, longs as eight bytes, ints as four."""
    for kind, v in values:
        raw = v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed % 2**64)
    return seed


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _plain_signature(text: str) -> list[str]:
    """Consistent weighted sampling of a text's words, drawn one by one from its definition."""
    out = []
    weights = Counter(words(text))
    for k in range(SAMPLES):
        least = None
        for w, n in weights.items():
            term = _signed(_hash(("s", w)))
            a, b = _hash(("l", term), ("i", k)), _hash(("i", k), ("l", term))
            part = lambda x, shift: ((x >> shift & 0x1FFFFFF) + 0.5) / (1 << 25)
            r = -math.log(part(a, 39) * part(a, 14))
            lnc = math.log(-math.log(part(b, 39) * part(b, 14)))
            beta = ((a & 0x3FFF) * 0x4000 + (b & 0x3FFF)) / (1 << 28)
            t = math.floor(math.log(n) / r + beta)
            rank = int((lnc - r * (t - beta) - r + 96.0) * (1 << 21))
            offer = (rank, _hash(("l", term), ("l", t)) >> 32)
            least = offer if least is None or offer < least else least
        out.append(f"{least[1]:08x}")
    return out


def test_signatures_equal_plain_sampling(spark):
    """Every sample of every document, but for those that the last bit of a logarithm decides."""
    texts = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    same = total = 0
    for r in fingerprints(docs(spark)).collect():
        plain = _plain_signature(texts[r.doc_id]) if len(texts[r.doc_id]) < 6000 else None
        if plain is not None:
            total += len(plain) * bool(words(texts[r.doc_id]))
            same += sum(r.fingerprint[8 * i : 8 * i + 8] == x for i, x in enumerate(plain)) if r.fingerprint else 0
            assert bool(r.fingerprint) == bool(words(texts[r.doc_id]))
    assert total > 3000 and same >= 0.9999 * total
