import hashlib
import random

import numpy as np
import pytest

from loreloom.llm.weighted_sampling import Sampler, as_text, fingerprint_documents, terms_of, with_follower


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    for share in (0.1, 0.5, 0.9):
        errors = []
        for _ in range(12):
            a = {f"w{rng.random()}": rng.randint(1, 9) for _ in range(60)}
            b = {k if rng.random() < share else k + "x": max(1, v + rng.randint(-1, 1)) for k, v in a.items()}
            s = Sampler(512)
            errors.append((s.signature(a) == s.signature(b)).mean() - jaccard(a, b))
        assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.1


def test_order_and_number_of_terms_change_nothing():
    words = [f"w{i % 1700}" for i in range(4000)]
    assert as_text(Sampler().signature(terms_of(" ".join(words)))) == as_text(Sampler().signature(terms_of(" ".join(words[::-1]))))


ROWS = [(5, "a b c d e f g h i"), (9, "nine nine nine"), (2, ""), (3, None), (7, "q" * 20_000 + " z"), (11, "é ü ñ"),
        (12, "a b c d e f g h i"), (-4, "x y z x y z")]


@pytest.mark.parametrize("run_rows", [2000, 2])
def test_rows_are_those_of_a_plain_loop(spark, monkeypatch, run_rows):
    monkeypatch.setattr(with_follower, "__defaults__", (run_rows,))
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in [*ROWS, (None, "no id at all"), (9, "nine nine nine")]],
                                  "doc_id bigint, text string, near_next double")
    got = sorted((r.asDict() for r in fingerprint_documents(frame).collect()),
                 key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["edited_sha256"]))
    order = sorted([*ROWS, (9, "nine nine nine")], key=lambda r: (-r[0], r[1] or ""))
    sampler, wanted = Sampler(), []
    for k, (i, t) in enumerate([*order, (None, "no id at all")]):
        t = t or ""
        following = (order[(k + 1) % len(order)] if i is not None else order[0])[1] or ""
        n = len(t) // 3
        changed = t[:len(t) - n] + following[:n]
        own, new, other = (sampler.signature(terms_of(x)) for x in (t, changed, following))
        wanted.append({"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
                       "fingerprint": as_text(own), "edited_fingerprint": as_text(new),
                       "near_edited": (own == new).mean(), "near_next": (own == other).mean()})
    wanted.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["edited_sha256"]))
    assert got == wanted


def test_only_rows_without_id(spark):
    got = fingerprint_documents(spark.createDataFrame([(None, "a b c d")], "doc_id bigint, text string")).collect()
    assert len(got) == 1 and got[0].near_next == 1.0


def test_empty_table(spark):
    assert fingerprint_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
