import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from chainframe.schema import RESIDUES  # noqa: E402
from chainframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "chainframe-tests")
    yield session
    session.stop()


class Chain:
    """A small chain in plain Python, with the direct way to compute things."""

    def __init__(self, name, n, seed=0, labels="HEC", edge=None):
        rng = np.random.default_rng(seed)
        edge = edge or 25 * (n / 50) ** (1 / 3)
        self.name, self.n = name, n
        self.xyz = rng.uniform(0, edge, (n, 3)).astype("f4")
        self.plddt = rng.integers(20, 100, n).astype("f4")
        self.rel = rng.uniform(0, 1, n).astype("f4")
        self.ss = "".join(rng.choice(list(labels), n))
        self.pae = rng.integers(0, 32, (n, n))

    def rows(self):
        return [
            ("human", self.name, i + 1, self.n, "A", float(self.plddt[i]), 0.0, float(self.rel[i]), 0, self.ss[i],
             *[float(v) for v in self.xyz[i]])
            for i in range(self.n)
        ]

    def dist(self, i, j):
        a, b = self.xyz[i - 1].astype("f8"), self.xyz[j - 1].astype("f8")
        return math.sqrt(float(((a - b) ** 2).sum()))

    def pairs(self, radius):
        return {
            (i, j) for i in range(1, self.n + 1) for j in range(i + 1, self.n + 1) if self.dist(i, j) <= radius
        }

    def runs(self, label):
        out, start = [], None
        for i, s in enumerate(self.ss + " ", 1):
            if s == label and start is None:
                start = i
            if s != label and start is not None:
                out.append((start, i - 1))
                start = None
        return out

    def mean(self, s, e):
        return float(self.plddt[s - 1 : e].astype("f8").mean())


@pytest.fixture(scope="session")
def chains():
    """Sizes around block borders, a single position, one label only."""
    return [
        Chain("c120", 120, 1), Chain("c80", 80, 2), Chain("c35", 35, 3), Chain("c1", 1, 4),
        Chain("noh", 33, 5, labels="EC"), Chain("allh", 48, 6, labels="H"),
    ]


def frame(spark, chains):
    return spark.createDataFrame([r for c in chains for r in c.rows()], RESIDUES)


@pytest.fixture(scope="session")
def residues(spark, chains):
    return frame(spark, chains).cache()


@pytest.fixture(scope="session")
def pae_rows(spark, chains):
    rows = [
        ("human", c.name, i + 1, [int(v) for v in c.pae[i]]) for c in chains if c.name != "c35" for i in range(c.n)
    ]
    return spark.createDataFrame(rows, "species string, uniprot string, i long, pae array<smallint>").cache()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of 16 and tiles of 4 positions, so that every chain has borders."""
    for name, module in list(sys.modules.items()):
        if name.startswith("chainframe"):
            for constant, value in (("BLOCK", 16), ("TILE", 4)):
                if hasattr(module, constant):
                    monkeypatch.setattr(module, constant, value)
