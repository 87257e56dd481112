"""Queries against their SQL on small tables with odd rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from colloquy.plans.queries import ORACLE_SQL, QUERIES
from tests.test_catalogue import shown


def both(spark, folder, name, **tables):
    """What the query and its SQL give for the tables, in order."""
    duck = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = QUERIES[name](spark, str(folder))
    said = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in said.description].index(c) for c in rows.columns]
    return sorted(tuple(map(shown, r)) for r in rows.collect()), sorted(tuple(shown(r[i]) for i in at) for r in said.fetchall())


def test_halves_are_rounded_as_single_precision_has_them(spark, tmp_path):
    vectors = pa.array([[-0.1335, 0.5], [-0.2765, 0.1925], [0.0005, -0.0005]], pa.list_(pa.float32()))
    got, expected = both(spark, tmp_path, "embedding_literal", embeddings={"vec_id": pa.array([1, 2, 3], pa.int64()), "embedding": vectors, "label": pa.array([0, 0, 1], pa.int32())})
    assert got == expected


def test_a_name_cut_short_by_the_end_of_its_text_is_none(spark, tmp_path):
    texts = ["ann lee bob", "ann lee bob kim", "ann lee", "", None, "ann lee bob kim lee"]
    got, expected = both(spark, tmp_path, "names_found", documents={"doc_id": pa.array([3 * i for i in range(6)], pa.int64()), "text": texts})
    assert got == expected
