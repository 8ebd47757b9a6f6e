"""The tagger's passes over whole texts against the ones it is trained with."""

import numpy as np

from chronofit.llm import pii, tagger


def test_tanh():
    x = np.linspace(-60, 60, 100_001).astype(np.float32)
    got = tagger.fast_tanh(x.copy(), *np.empty((3, len(x)), np.float32))
    assert np.abs(got - np.tanh(x.astype(float))).max() < 2e-5


def test_emissions_equal_those_of_training():
    model = tagger.Tagger(9)
    for k in model.p:
        model.p[k] = model.p[k] * np.float32(1.5)
    ids = np.random.default_rng(3).integers(0, tagger.N_CHARS, (5, 300)).astype(np.uint8)
    (f, _), (b, _) = (model._run(d, np.ascontiguousarray(ids.T)) for d in "fb")
    plain = np.concatenate([f, b], axis=2) @ model.p["O"] + model.p["o"]
    assert np.allclose(model.emissions(ids), plain, atol=1e-3)


def test_only_stretches_that_can_be_reported_are_decoded(monkeypatch):
    """Where every character is in doubt, texts without an at sign or four digits are scored but not decoded."""
    model, decoded, scored = tagger.Tagger(9), [], []
    model.p["o"][4] = 40
    plain, score = model.viterbi, model.emissions
    monkeypatch.setattr(model, "viterbi", lambda e: decoded.append(len(e)) or plain(e))
    monkeypatch.setattr(model, "emissions", lambda ids: scored.append(ids.size) or score(ids))
    assert pii.tagged_spans(model, ["only words here, 12 and 3", "none"]) == [[], []]
    assert not decoded and scored
    spans = pii.tagged_spans(model, ["words", "10 . 0 . 0 . 7"])
    assert len(decoded) == 1 and spans == [[], [(1, 0, 14)]]


def test_what_is_reported_holds_what_is_needed():
    g = np.random.default_rng(11)
    alphabet = list("0123456789@.-() ax") + ["[at]", "(at)", "[dot]"]
    made = [pii.variant(k, pii._MODELS[k], g) for k in range(4) for _ in range(200)]
    made += ["".join(alphabet[int(i)] for i in g.integers(0, len(alphabet), g.integers(1, 24))) for _ in range(20_000)]
    for s in made:
        assert pii._NEEDED.search(s) or not any(pii.plausible(k, s) for k in range(4)), s
