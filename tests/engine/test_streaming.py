import numpy as np

from triadic.operators import spectra as S
from triadic.plans.config import FitConfig
from triadic.sources import arrays
from triadic.streaming.blocks import streamed_blocks


def test_streamed_blocks_are_those_of_the_batch(spark, tmp_path):
    q = np.random.default_rng(5).standard_normal((70, 3, 1))
    q -= q.mean(axis=0)
    field = arrays.from_array(spark, q)
    config = FitConfig(n_dft=16, time_step=1.0, n_overlap=8)
    for i, (a, b) in enumerate(((0, 20), (40, 70), (20, 40))):  # the middle comes last
        field.where(f"t >= {a} AND t < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(field.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = streamed_blocks(stream, config, [0, 1, 3]).writeStream.format("memory").queryName("blocks").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.p, r.b, r.f): complex(r.re, r.im) for r in spark.table("blocks").collect()}
    want = {(r.p, r.b, r.f): complex(r.re, r.im) for r in S.realizations(field, 16, 8, config.blocks(70), [0, 1, 3]).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 7 * 3
    assert max(abs(got[k] - want[k]) for k in got) < 1e-12
