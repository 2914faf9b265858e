from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from corpusgraph.plans.catalog import ORACLES, QUERIES


def test_number_signs_at_the_end_of_a_title_as_in_sql(spark, tmp_path):
    titles = ["A ###", "A ### ", "A ###\n", " A\t#\n#", "A # b", "A <b>b</b>#<i> </i>", "A ## </h1><h1>B"]
    pq.write_table(pa.table({"page_id": range(len(titles)), "url": [f"https://h/{i}" for i in range(len(titles))], "html": [f"<title>t</title><h1>{t}</h1>" for t in titles[:-1]] + [f"<h1>{titles[-1][:5]}</h1>"]}), tmp_path / "pages.parquet")
    pages = pq.read_table(tmp_path / "pages.parquet")  # noqa: F841
    want = duckdb.sql(ORACLES["page_title"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet'")).fetchall()
    got = QUERIES["page_title"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and {r.page_id: r.title for r in got}[1] == "A ###"
