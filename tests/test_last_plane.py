"""Queries over tables whose vectors end within a plane, beside their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module", params=[106, 83], ids=["good", "hole"])
def folder(request, tmp_path_factory):
    """Vectors of four planes and six rows; or of three and eight, the last of which is a hole of NaN."""
    out, n = tmp_path_factory.mktemp("vectors"), request.param
    values = np.random.default_rng(5).normal(0, 0.2, (n, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(values), "label": np.zeros(n, np.int32)}), out / "embeddings.parquet")
    return str(out)


def compared(spark, folder, name):
    """Rows of a query and of its SQL, in the order of the SQL's columns."""
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
        want = db.sql(entry.oracle_sql()[name])
        found = entry.queries()[name](spark, folder).select(*want.columns).collect()
        text = lambda rows: sorted(map(repr, map(tuple, rows)))
        return text(found), text(want.fetchall())


@pytest.mark.parametrize("name", ["stream_region_statistics", "zarr_logical_order", "zarr_histogram_sampled", "zarr_raw_sink", "zarr_spatial_sample", "zarr_spectrum", "zarr_region_stats_masked", "zarr_region_stats", "zarr_blocks", "zarr_rounded", "spectral_reduce", "spectral_mean_variance", "nan_chunks", "zarr_fits_sink", "zarr_world", "zarr_sql_text"])
def test_queries_equal_their_sql(spark, folder, name):
    found, want = compared(spark, folder, name)
    assert found == want
