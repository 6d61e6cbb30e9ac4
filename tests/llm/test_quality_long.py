"""Quality of texts with very many lines."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from skein.llm import quality

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def field():
    rng = np.random.default_rng(3)
    return quality.LineField(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))


def texts():
    rng = np.random.default_rng(4)
    kinds = ["", "A line of words.", "x", "BUY NOW!!! 123 $$$", "the the the", "é" * 30]
    return ["\n".join(kinds[k] for k in rng.integers(0, len(kinds), n)) for n in (1, 2, 3, 50, 51, 400)] + ["\n" * 99, ""]


@pytest.mark.parametrize("stretch", [1, 7, 1000])
def test_long_texts_score_as_others(field, monkeypatch, stretch):
    given = texts()
    want = field.score(given)
    monkeypatch.setattr(quality, "STRETCH", stretch)
    monkeypatch.setattr(quality, "LONG_LINES", 1)
    assert field.score([*given, None]) == pytest.approx([*want, want[-1]], abs=1e-9)


def test_a_chain_by_blocks_is_the_chain(field):
    lines = quality.Lines([texts()[5]])
    good = lines.x @ field.weights
    assert quality._chain_marginals(good, np.exp(field.ties)) == pytest.approx(field.line_marginals(lines), abs=1e-9)


def test_ten_megabytes_of_line_ends_fit_a_worker():
    code = (
        "import resource, numpy as np; from skein.llm import quality as q; f = q.LineField(np.full(q.WIDTH, 0.1), np.eye(2));"
        "s = f.score(['\\n' * 10_000_000]); assert 0 <= s[0] <= 1; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True, text=True, timeout=300)
    assert int(out.stdout) < 1_100_000
