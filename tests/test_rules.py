"""Rules of a table on turns of every number, against the query's SQL and plain results."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from loredeck import registry

RULES = [(1, "english alpha"), (2, "french alpha"), (3, "General omega"), (4, "omega shared"), (5, "disabled words"), (6, "omega french only"), (7, "shared"), (None, "nobody"), (8, None), (9, "")]
TURNS = [
    (2, 0, "alpha"), (2, 1, None), (2, 2, "x omegax"), (2, 7, "SHARED"), (2, 900, "disabled"), (1, 3, "alpha"), (3, 6, "english"), (-1, -1, "only"),
    (4, 5, "shared"), (4, 5, "alpha"), (4, 5, ""), (4, None, "alpha"), (None, 4, "alpha"), (None, None, "omega"),
]


def test_rule_table_match_reads_all_turns(spark, tmp_path):
    tables = {"benchmark": (["item_id", "text"], RULES), "conversations": (["conv_id", "turn", "text"], TURNS)}
    duck = duckdb.connect()
    for name, (columns, rows) in tables.items():
        kinds = [pa.string() if c == "text" else pa.int64() for c in columns]
        pq.write_table(pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns), tmp_path / f"{name}.parquet")
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = sorted(map(str, map(tuple, registry.queries()["rule_table_match"](spark, str(tmp_path)).collect())))
    first = {(2, 0): 1, (2, 2): 3, (2, 7): 4, (1, 3): 2, (-1, -1): 6, (4, 5): 1}  # rows of one turn share the first rule
    assert got == sorted(str((c, t, first.get((c, t)))) for c, t, _ in TURNS)
    assert got == sorted(map(str, duck.execute(registry.oracles()["rule_table_match"]).fetchall()))
