"""Queries against their SQL on tables with larger keys than the fixtures have."""

import os

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from helpers import SF, TABLES, oracle, rows_of

from rasterflow import registry


def shifted(folder, table, key, shifts):
    """A folder of all tables, of which one is repeated with its key shifted."""
    for t in TABLES.split():
        if t != table:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    rows = pq.read_table(f"{SF}/{table}.parquet")
    at = rows.schema.get_field_index(key)
    copies = [rows.set_column(at, key, pc.add(rows[key], pa.scalar(s, rows.schema.field(key).type))) for s in shifts]
    pq.write_table(pa.concat_tables(copies), folder / f"{table}.parquet")
    return str(folder)


def test_layer_bindings_of_large_keys(spark, tmp_path):
    sf = shifted(tmp_path, "part", "p_partkey", (0, 99_000, 100_000, 500_000))
    assert rows_of(registry.QUERIES["layer_bindings"](spark, sf)) == oracle(registry.ORACLE_SQL["layer_bindings"], sf)
