"""The attention model against a plain forward pass in double precision, also where exponents are large."""

import numpy as np
import pytest

from vecprune.llm import attention


def plain_scores(params, inputs, targets):
    p = {name: value.astype(float) for name, value in params.items()}
    e = p["embed"][inputs]
    place = np.arange(attention.LENGTH)
    distance = place[:, None] - place
    att = (e @ p["query"]) @ (e @ p["key"]).transpose(0, 2, 1) / np.sqrt(attention.WIDTH) + p["bias"][np.maximum(distance, 0)]
    att = np.where(distance >= 0, att, -np.inf)
    att = np.exp(att - att.max(axis=-1, keepdims=True))
    att /= att.sum(axis=-1, keepdims=True)
    h = np.tanh((att @ (e @ p["value"]) + e) @ p["mix"] + p["mix_bias"])
    high, low = targets // attention.SIDE, targets % attention.SIDE
    total = 0
    for z, goal in ((h @ p["high"] + p["high_bias"], high), (h @ p["low"] + p["low_bias"][high], low)):
        z -= z.max(axis=-1, keepdims=True)
        total = total + np.take_along_axis(z, goal[..., None], -1)[..., 0] - np.log(np.exp(z).sum(axis=-1))
    return total


def model(scale=1, out=1):
    rng = np.random.default_rng(5)
    params = attention.initial(rng.integers(1, 100, attention.SLOTS).astype(float))
    params["embed"] *= scale
    params["query"] *= scale
    params["high"] *= out
    return params


def windows(n):
    slots = np.random.default_rng(n).integers(0, attention.SLOTS, (n, attention.LENGTH + 1))
    return slots[:, :-1], slots[:, 1:]


@pytest.mark.parametrize("scale, out", [(1, 1), (3, 1), (30, 1), (30, 300), (1, 300)])
@pytest.mark.parametrize("n", [1, 8, 150])
def test_scores_equal_a_plain_pass(n, scale, out):
    params, (inputs, targets) = model(scale, out), windows(n)
    scorer, want = attention.Scorer(params), plain_scores(params, inputs, targets)
    # Single precision leaves some 1e-4 of an exponent of many hundreds.
    near = 1e-5 if scale * out < 30 else 1e-3
    np.testing.assert_allclose(scorer.score(inputs, targets), want, rtol=near, atol=near)
    rest = scorer.score(inputs, targets, attention.CONTEXT)
    np.testing.assert_allclose(rest, want[:, attention.CONTEXT :], rtol=near, atol=near)


@pytest.mark.parametrize("scale, out", [(1, 1), (3, 1), (1, 300)])
def test_slopes_equal_differences(scale, out):
    params, (inputs, targets) = model(scale, out), windows(150)
    weight = (np.random.default_rng(1).random(targets.shape) < 0.9).astype(np.float32)
    found, rng = attention.slopes(params, inputs, targets, weight), np.random.default_rng(2)
    for name, shape in attention.SHAPES.items():
        way = rng.standard_normal(shape)
        way /= np.linalg.norm(way)
        up, down = ({**params, name: params[name].astype(float) + d * way} for d in (1e-5, -1e-5))
        rise = plain_scores(down, inputs, targets) - plain_scores(up, inputs, targets)
        want = (rise * weight).sum() / weight.sum() / 2e-5
        assert (found[name] * way).sum() == pytest.approx(want, rel=2e-3, abs=1e-5)


def test_steps_use_the_same_arrays():
    inputs, targets = windows(256)
    descent = attention.Descent(model(), 0.02)
    both = np.hstack([inputs, targets[:, -1:]])
    descent.feed(both[:128], np.ones((128, attention.LENGTH), np.float32))
    before = {name: id(x) for name, x in descent.room.whole.items()}
    descent.feed(both[128:], np.ones((128, attention.LENGTH), np.float32))
    assert before and before == {name: id(x) for name, x in descent.room.whole.items()}
