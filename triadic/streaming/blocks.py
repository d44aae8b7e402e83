"""Spectra of completed blocks from a stream of samples: an extension, as fits themselves are batch.

A fit needs the mean of all samples; a stream has none, so a known mean (or 0) is given. Each point and
variable keeps the samples that later blocks still need, at most n_dft plus what came early, and emits a block's
chosen frequencies as soon as its last sample is there. Samples may come in any order; a sample that comes
again overwrites itself if its block is open and is dropped if all its blocks were emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from triadic.plans.config import FitConfig
from triadic.plans.decompose import taper

OUTPUT = "p long, v int, b long, f int, re double, im double"
STATE = "next long, t array<long>, value array<double>"


def streamed_blocks(samples: DataFrame, config: FitConfig, freqs: list[int], mean: float = 0.0) -> DataFrame:
    """(t, p, v, value) stream -> (p, v, b, f, re, im) of each block once it is complete, in append mode."""
    window = taper(config)
    wanted = np.asarray(freqs)
    kernel = np.exp(-2j * np.pi * np.outer(wanted, np.arange(config.n_dft)) / config.n_dft) / (window.mean() * config.n_dft)

    def advance(key, batches, state):
        p, v = key
        nxt, held = 0, {}
        if state.exists:
            nxt, t, value = state.get
            held = dict(zip(t, value))
        for pdf in batches:
            fresh = pdf[pdf["t"] >= nxt * config.step]
            held.update(zip(fresh["t"].tolist(), fresh["value"].astype(float).tolist()))
        out = []
        while all(t in held for t in range(nxt * config.step, nxt * config.step + config.n_dft)):
            y = np.array([held[t] for t in range(nxt * config.step, nxt * config.step + config.n_dft)]) - mean
            q = kernel @ (y * window)
            out.append(pd.DataFrame({"p": p, "v": v, "b": nxt, "f": wanted, "re": q.real, "im": q.imag}))
            nxt += 1
            held = {t: x for t, x in held.items() if t >= nxt * config.step}
        state.update((nxt, list(held), list(held.values())))
        yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("p", "v", "b", "f", "re", "im")})

    return samples.groupBy("p", "v").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
