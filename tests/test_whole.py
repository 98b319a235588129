"""Queries that take every row of their table."""

import duckdb

from stratavox.plans import queries as plans


def test_message_inventory_of_all_levels(spark, small):
    got = plans.queries()["message_inventory"](spark, small).toPandas()
    parts = duckdb.sql(f"SELECT p_brand, p_size FROM '{small}/part.parquet'").df()
    assert got["n"].sum() == len(parts)
    for r in got.itertuples():
        sizes = parts[parts.p_brand == r.short_name].p_size
        assert (r.n, r.least, r.most) == (len(sizes), sizes.min(), sizes.max())
        assert set(map(int, r.levels.split(","))) == set(sizes)
    assert any(int(x) % 2 for levels in got["levels"] for x in levels.split(","))


def test_components_of_all_line_items(spark, small):
    got = plans.queries()["components"](spark, small).toPandas()
    keys = duckdb.sql(f"SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM '{small}/lineitem.parquet'").fetchall()
    cells = {(line, order % 128, order // 128): order * 8 + line for order, line in keys}
    parent = {i: i for i in cells.values()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (x, y, z), i in cells.items():
        for step in ((x + 1, y, z), (x, y + 1, z), (x, y, z + 1)):
            if step in cells:
                a, b = find(i), find(cells[step])
                parent[max(a, b)] = min(a, b)
    assert len(got) == len(keys)
    assert dict(zip(got["idx"], got["root"], strict=True)) == {i: find(i) for i in parent}
    assert 1 < got["root"].nunique() < len(got)


def test_cloud_figures_of_all_cloudy_cells(spark, small):
    got = plans.queries()["cloud_figures"](spark, small).toPandas()
    cloudy = duckdb.sql(f"SELECT count(*), sum((l_partkey % 101) / 100.0) FROM '{small}/lineitem.parquet' WHERE l_partkey % 101 > 0").fetchall()[0]
    assert got["n_cells"].sum() == cloudy[0]
    assert abs(got["mt"].sum() - cloudy[1]) < 1e-3
