import numpy as np
import pytest

from noctua.functions.kernels import band_pass
from noctua.operators import features


@pytest.mark.parametrize(("epochs", "size", "block"), [(40, 64, 256), (40, 64, 100), (7, 500, 128), (2, 30, 16)])
def test_blocks_give_the_whole_signal(spark, epochs, size, block):
    """Blocks, shorter or longer than an epoch, give what the filter gives over the whole group."""
    x = np.random.default_rng(1).normal(size=epochs * size)
    rows = [("n", i, x[i * size : (i + 1) * size].tolist()) for i in range(epochs)]
    df = spark.createDataFrame(rows, "night string, epoch long, samples array<double>")
    got = {r.epoch: r.samples for r in features.filtered(df, ["night"], "epoch", 1.0, 20.0, 64.0, block=block).collect()}
    assert sorted(got) == list(range(epochs)) and all(len(v) == size for v in got.values())
    assert np.concatenate([got[i] for i in range(epochs)]) == pytest.approx(band_pass(x, 64.0, 1.0, 20.0), abs=1e-9)
