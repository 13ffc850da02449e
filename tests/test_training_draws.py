"""Mutations draw what choice would draw, without a call of it for every place."""

import numpy as np

from strandmill.operators import training_data


class Counted:
    def __init__(self, rng):
        self.rng, self.choices = rng, 0

    def choice(self, *a, **k):
        self.choices += 1
        return self.rng.choice(*a, **k)

    def __getattr__(self, name):
        return getattr(self.rng, name)


def plain(seq, identity, rng, kinds):
    n = min(round(len(seq) * (1 - identity)), len(seq))
    out = list(seq)
    for at, kind in zip(rng.choice(len(seq), size=n, replace=False), rng.choice(3, size=n, p=kinds), strict=True):
        if kind == 0:
            out[at] = rng.choice([b for b in "ACGT" if b != out[at]])
        else:
            out[at] = rng.choice(list("ACGT")) + out[at] if kind == 1 else ""
    return "".join(out)


def test_same_draws_with_one_choice():
    for seed in range(40):
        seq = "".join(np.random.default_rng(seed).choice(list("ACGTX "), size=90))
        rng = Counted(np.random.default_rng([7, seed]))
        got, _ = training_data.mutate(seq, 0.7, rng, (0.4, 0.3, 0.3))
        assert got == plain(seq, 0.7, np.random.default_rng([7, seed]), (0.4, 0.3, 0.3)) and rng.choices == 1


def test_windows_of_several_pieces(spark):
    texts = {i: "".join(chr(97 + (i + k * k) % 26) for k in range(n)) for i, n in enumerate((0, 9, 10, 399, 400, 401, 410, 4005))}
    got = training_data.full_windows(spark.createDataFrame(list(texts.items()), "contig long, sequence string"), 10, 10).collect()
    want = {(i, k * 10, t[k * 10 : k * 10 + 10].upper()) for i, t in texts.items() for k in range(len(t) // 10)}
    assert len(got) == len(want) and {(r.contig, r.start, r.seq) for r in got} == want
