import numpy as np
import pytest

from rallyforge.operators import vision

CENTRE, R0, K = np.array([310.0, 240.0]), 400.0, -0.17
H = np.array([[4.1, 0.3, 3.1], [-0.2, 7.3, 6.0], [0.03, 0.31, 1.0]])  # (pixel - centre) / r0, without the lens, to metres


def pixels(court):
    u = np.c_[court, np.ones(len(court))] @ np.linalg.inv(H).T
    u = u[:, :2] / u[:, 2:]
    far = (u**2).sum(axis=1)
    return CENTRE + R0 * u * (2 / (1 + np.sqrt(1 - 4 * K * far)))[:, None]


def traces(rng, noise):
    s = np.linspace(0, 1, 80)
    lines = {f"x{v}": (pixels(np.c_[np.full(80, v), s * 9.75]), "x", v) for v in (0.0, 1.6, 4.8, 6.4)} | {f"y{v}": (pixels(np.c_[s * 6.4, np.full(80, v)]), "y", v) for v in (1.0, 5.44, 7.04, 9.75)}
    return {n: (p + rng.normal(0, noise, p.shape), a, v) for n, (p, a, v) in lines.items()}


@pytest.mark.parametrize("wrong", [0, 9])
def test_floor_and_lens_are_found(wrong):
    rng = np.random.default_rng(1)
    lines = traces(rng, 0.3)
    for n in list(lines)[:4]:  # traces that leave their line here and there
        lines[n][0][:wrong] += 25
    fit = vision.FloorFit(lines, {"T": (pixels(np.array([[3.2, 5.44]]))[0], (3.2, 5.44), 4.0)}, tuple(CENTRE), R0)
    assert abs(fit.k - K) < (0.04 if wrong else 0.02)
    grid = np.array([(x, y) for x in (0.5, 3.2, 6.0) for y in (1.0, 5.0, 9.0)])
    assert np.abs(fit.to_court(pixels(grid)) - grid).max() < (0.1 if wrong else 0.05)
    quality = fit.quality()
    assert quality["y5.44"][1] < 0.03 and quality["T"][1] < 0.03 and quality["y5.44"][0] == 80


def test_corners_and_too_few_of_them():
    lines = traces(np.random.default_rng(2), 0.0)
    found = vision.corners(lines)
    assert 12 <= len(found) <= 16 and all(np.hypot(*(spot - pixels(np.array([place]))[0])) < 25 for spot, place in found)
    with pytest.raises(ValueError, match="four"):
        vision.FloorFit({n: v for n, v in lines.items() if n in ("x0.0", "y5.44")}, {}, tuple(CENTRE), R0)
