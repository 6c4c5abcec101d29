import zlib

import numpy as np
import pytest

from loreloom.llm.langid import Network, Reader, fitted, gradients, identify, predict_languages, windows_of

EN = "the cat and the dog of this house went with that man to the water and it was for the best "
DE = "der hund und die katze sind nicht im haus weil es schön ist auch wenn der wind über das dach weht "


def test_gradients_are_numeric_ones():
    rng = np.random.default_rng(3)
    net = Network.fresh(["a", "b"], 3, 1)
    for name in ("inp", "rec"):
        setattr(net, name, [x.astype(np.float64) for x in getattr(net, name)])
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    octets = rng.integers(97, 101, (6, 4))
    weights = np.ones((6, 4))
    weights[4:, 1] = 0
    target = np.array([0, 1, 1, 0])
    _, grads = gradients(net, octets, weights, target)
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(5)] + ([(98, 1)] if p.shape[0] == 256 else []):
            old = p[at]
            p[at] = old + 1e-3
            up, _ = gradients(net, octets, weights, target)
            p[at] = old - 1e-3
            down, _ = gradients(net, octets, weights, target)
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_windows_hold_every_byte():
    texts = [b"", b"a" * 5, bytes(range(256)) * 3]
    octets, valid, owner = windows_of(texts)
    for i, text in enumerate(texts):
        assert b"".join(octets[:n, j].tobytes() for j, n in enumerate(valid) if owner[j] == i) == text


def test_reader_labels_as_the_network_does():
    net = Network.fresh(["x", "y", "z"], 5, 2)
    text = bytes(np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8))
    sums, counts = Reader(net).pooled([b"", text])
    from loreloom.llm.langid import _softmax, _states

    total = np.zeros(3)
    for at in range(0, 300, 128):
        part = np.frombuffer(text[at:at + 128].ljust(128), np.uint8)[:, None]
        f, b = _states(net, part, 0)[0][1:], _states(net, part[::-1], 1)[0][1:][::-1]
        total += _softmax(np.concatenate([f, b], 2) @ net.out + net.bias)[:min(128, 300 - at), 0].sum(0)
    assert sums[1] == pytest.approx(total, rel=1e-3)
    assert counts[1].sum() == 300 and not counts[0].any() and not sums[0].any()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, (EN if i % 2 else DE) * 4 + str(i), "en" if i % 2 else "de", "clash") for i in range(120)]
    rows += [(None, EN, None, "c"), (200, None, "en", "c"), (201, "", "en", "c"), (202, "123 !!", "en", "c"),
             (203, EN * 3000, None, "c"), (203, EN * 3000, None, "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string").repartition(3)


def test_predictions(docs):
    got = {}
    for r in predict_languages(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    for i in range(120):
        r = got[i][0]
        assert r.lang_pred == ("en" if i % 2 else "de") and 0.5 < r.score <= 1
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert sum(r.positions.values()) == len(((EN if i % 2 else DE) * 4 + str(i)).encode())
    for i in (200, 201, 202):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert got[None][0].lang_pred == "en" and got[None][0].held_out is False
    assert len(got[203]) == 2 and got[203][0].score == pytest.approx(got[203][1].score)


def test_identify_keeps_other_columns(docs):
    net = fitted(docs)
    out = identify(docs, net, name="found")
    assert out.columns == [*docs.columns, "found"]


def test_empty_table_and_no_labels(spark, docs):
    assert predict_languages(docs.limit(0)).count() == 0
    bare = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert predict_languages(bare).first().lang_pred == "und"


def test_held_out_accuracy_on_documents(spark):
    from loreloom.llm.queries import op2_byte_gru

    found = op2_byte_gru(spark, "/root/testdata/sf0.01")
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(given, "doc_id").selectExpr("avg(cast(lang = lang_pred as int))").first()
    assert rows[0] > 0.95
