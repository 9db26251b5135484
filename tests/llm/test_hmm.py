"""The language model against plain recursions, counts and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import hmm


def model(symbols, seed=7):
    r = np.random.default_rng(seed)
    part = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(r.gamma(0.5, size=shape) + 1e-3)
    return hmm.Model(part(hmm.STATES), part(hmm.STATES), part(hmm.STATES, hmm.STATES), part(hmm.STATES, symbols).T)


def plain(row, m, first):
    """Unscaled forward and backward tables."""
    ahead = [first * m.emit[row[0]]]
    for s in row[1:]:
        ahead.append((ahead[-1] @ m.step) * m.emit[s])
    behind = [np.ones(hmm.STATES)]
    for s in row[:0:-1]:
        behind.append(m.step @ (m.emit[s] * behind[-1]))
    return np.array(ahead), np.array(behind[::-1])


def test_recursions_equal_plain_ones():
    m, r = model(40), np.random.default_rng(1)
    rows = [r.integers(0, 40, n).astype("<u2") for n in (1, 7, 3, 20, 7, 1)]
    begins = [True, False, True, True, False, False]
    logs = [math.log10(plain(x, m, m.first)[0][-1].sum()) for x in rows]
    assert np.allclose(hmm.likelihoods(rows, m), logs)
    found = hmm.Expected(m)
    found.add(rows, begins)
    first, step, emit, log = np.zeros(hmm.STATES), np.zeros_like(m.step), np.zeros_like(m.emit), 0.0
    for x, b in zip(rows, begins):
        ahead, behind = plain(x, m, m.first if b else m.usual)
        total = ahead[-1].sum()
        gamma = ahead * behind / total
        first += gamma[0] * b
        np.add.at(emit, x, gamma)
        for t in range(len(x) - 1):
            step += ahead[t][:, None] * m.step * (m.emit[x[t + 1]] * behind[t + 1])[None] / total
        log += math.log10(total)
    assert np.allclose(found.first, first) and np.allclose(found.step, step) and np.allclose(found.emit, emit) and math.isclose(found.log, log)


@pytest.mark.parametrize("n", [1024, 1025, 5000])
def test_long_texts_are_scored_alike_by_segments(n):
    m = model(30)
    row = np.random.default_rng(n).integers(0, 30, n).astype("<u2")
    assert math.isclose(hmm.likelihood_long(row, m), hmm.likelihoods([row], m)[0], rel_tol=1e-9)


def base_of(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    seen = Counter(w for d, t in rows if not held(d) for w in words(t))
    total, different = sum(seen.values()), len(seen)
    return sorted(((d, held(d), len(w), sum(seen[x] > 0 for x in w), total, round(sum(math.log10((seen[x] + 1) / (total + different + 1)) for x in w), 5)) for d, t in rows for w in [words(t)]), key=str)


def scores(docs):
    return hmm.op13_language_model_scores(docs).toPandas()


def test_counts_and_base(spark, awkward, nothing):
    found = hmm.op13_language_model_scores(awkward).collect()
    assert sorted((tuple(r)[:5] + (round(r["base_score"], 5),) for r in found), key=str) == base_of([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert hmm.op13_language_model_scores(nothing).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    found = scores(spark.createDataFrame([(i, "some words") for i in ids], "doc_id long, text string"))
    assert set(found["train_tokens"]) == {0} and set(found["n_known"]) == {0} and set(found["base_score"]) == {0.0} and np.isfinite(found["score"]).all()


def test_rounds_raise_the_likelihood_and_held_out_texts_beat_the_base(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = scores(docs)
    held = found[found["held_out"]]
    assert len(held) > 10 and held["score"].sum() > held["base_score"].sum() and (held["score"] > held["base_score"]).mean() > 0.8
    monkeypatch.setattr(hmm, "PRIOR", 1e-6)
    monkeypatch.setattr(hmm, "STEP_PRIOR", 1e-6)
    counts = hmm.counted(docs.where(~hmm.held_out(F.col("doc_id"))), "text")
    corpus = hmm.surveyed(counts)
    texts = hmm.encoded(docs, corpus, "text").where("NOT held_out").cache()
    m, logs = hmm.started(corpus), []
    for _ in range(4):
        m, log = hmm.trained(texts, m, corpus)
        logs.append(log)
    assert logs == sorted(logs) and logs[-1] > logs[0]


def test_words_outside_the_head_are_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    monkeypatch.setattr(hmm, "HEAD", 50)
    found = hmm.op13_language_model_scores(docs).collect()
    assert sorted((tuple(r)[:5] + (round(r["base_score"], 5),) for r in found), key=str) == base_of([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_workers_do_not_keep_the_words_of_an_earlier_run(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for part in (docs.where("doc_id < 60"), docs.where("doc_id >= 120"), docs.where("doc_id < 30")):
        found = hmm.op13_language_model_scores(part.coalesce(2)).collect()
        assert sorted((tuple(r)[:5] + (round(r["base_score"], 5),) for r in found), key=str) == base_of([(r["doc_id"], r["text"]) for r in part.collect()])


def test_every_round_learns_from_all_training_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(9)
    seen, trained = [], hmm.trained

    def watched(texts, model, corpus):
        seen.append((texts.agg(F.sum(F.length("symbols"))).first()[0] // 2, corpus.total))
        return trained(texts, model, corpus)

    monkeypatch.setattr(hmm, "trained", watched)
    monkeypatch.setattr(hmm, "WARM_TOKENS", 1000, raising=False)
    assert np.isfinite(scores(docs)["score"]).all()
    assert len(seen) >= 10 and all(tokens == total > 1000 for tokens, total in seen)


def scaled_at_every_place(rows, begins, m):
    """Expected counts and likelihood by recursions scaled at each place, a row per state."""
    laid, found = hmm.Packed(rows), np.zeros(m.emit.T.shape)
    ends, symbols, fresh = laid.ends.tolist(), laid.symbols.astype("i8"), np.array(begins)[laid.order]
    chance = np.array([c.take(symbols) for c in np.ascontiguousarray(m.emit.T)])
    forward, scale, paths = np.empty_like(chance), np.empty(len(symbols)), np.zeros_like(m.step)
    ahead, behind = np.where(fresh, m.first[:, None], m.usual[:, None]), np.ones((hmm.STATES, ends[-1] - ends[-2]))
    for at, end in zip(ends, ends[1:]):
        now = ahead[:, : end - at] * chance[:, at:end]
        now /= now.sum(0, out=scale[at:end])
        forward[:, at:end], ahead = now, m.step.T @ now
    chance /= scale
    for t in range(len(ends) - 2, -1, -1):
        at, end = ends[t], ends[t + 1]
        if t < len(ends) - 2:
            met = behind.shape[1]
            paths += forward[:, at : at + met] @ behind.T
            behind = np.hstack([m.step @ behind, np.ones((hmm.STATES, end - at - met))])
        forward[:, at:end] *= behind
        behind = behind * chance[:, at:end]
    for k in range(hmm.STATES):
        found[k] += np.bincount(symbols, weights=forward[k], minlength=found.shape[1])
    return forward[:, : ends[1]][:, fresh].sum(1), paths * m.step, found.T, float(np.log10(scale).sum())


def training_block():
    """A model of as many symbols as the largest one and a block of sequences, some emitted by hardly any state."""
    r, symbols = np.random.default_rng(3), hmm.TAILS + 1 + hmm.HEAD
    m = model(symbols)
    m.emit[:] = m.emit ** 3 + 1e-22
    rows = [np.minimum(r.zipf(1.3, n) - 1, symbols - 1).astype("<u2") for n in r.integers(1, hmm.STRETCH + 1, 1000)]
    return rows, (r.random(len(rows)) < 0.5).tolist(), hmm.Model(m.first, m.usual, m.step, m.emit / m.emit.sum(0))


def test_seldom_scaled_recursions_equal_ones_scaled_at_every_place():
    rows, begins, m = training_block()
    found = hmm.Expected(m)
    found.add(rows[:300], begins[:300])
    found.add(rows[300:], begins[300:])
    for mine, other in zip((found.first, found.step, found.emit, found.log), scaled_at_every_place(rows, begins, m)):
        assert np.allclose(mine, other, rtol=1e-9, atol=1e-12)
    assert math.isclose(found.emit.sum(), sum(map(len, rows)))


def test_chances_are_scaled_at_few_places(monkeypatch):
    rows, begins, m = training_block()
    plain, taken = np.log10, []
    monkeypatch.setattr(np, "log10", lambda x: taken.append(np.size(x)) or plain(x))
    hmm.Expected(m).add(rows, begins)
    hmm.likelihoods(rows, m)
    assert sum(taken) < 0.6 * sum(map(len, rows)), "every scaling takes a sum, a division and a logarithm: once for each symbol in both passes before"


def test_words_are_split_and_lowered_as_bytes_are():
    texts = [" lead", "trail ", "\x0b\x0cA\x1cB\x85 \xa0x y", "É İI ſK K\tZ", "", "  \t\n\r ", None, "a\x00b c\x00", "x" * 70 + " y"]
    plain = [(t or "").encode().lower().split() for t in texts]
    for column in (pa.array(texts), pa.array([*texts, "left out"]).slice(0, len(texts)), pa.array(["left out", *texts]).slice(1)):
        sizes, words = hmm.words_of(column)
        assert sizes.tolist() == list(map(len, plain)) and words.to_pylist() == [w for ws in plain for w in ws]
    assert hmm.classes_of(words).tolist() == [zlib.crc32(w[-2:]) % hmm.TAILS for w in words.to_pylist()]
    assert hmm.keys_of(words).to_pylist() == [hmm.key_of(w) for w in words.to_pylist()]
