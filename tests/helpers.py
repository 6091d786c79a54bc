"""Small random groups and brute-force counterparts."""

import numpy as np
from pyspark.sql import functions as F


def random_groups(seed=0, groups=3, rows=60, dims=4, copies=True):
    """{group: {entity: vector}} with clumps, exact copies and far-off points."""
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(groups):
        centres = rng.random((4, dims)) * 3
        x = centres[rng.integers(0, 4, rows)] + rng.normal(0, 0.15, (rows, dims))
        x[0] += 9
        if copies:
            x[5:9] = x[4]
        x[:, -1] = 0 if g == 0 else x[:, -1]
        out[g] = {f"e{g}_{i:03d}": x[i] for i in range(rows)}
    return out


def as_points(spark, groups, weight=1.0):
    rows = [(g, e, [float(c) for c in v], weight) for g, m in groups.items() for e, v in m.items()]
    return spark.createDataFrame(rows, "g int, id string, vec array<double>, weight double")


def as_vectors(spark, groups):
    return as_points(spark, groups).select("g", F.col("id").alias("entity"), "vec")


def distance_matrix(m):
    x = np.array(list(m.values()))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return list(m), x, d
