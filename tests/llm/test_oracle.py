"""SQL of native operators, on quotations and on the given table."""

from __future__ import annotations

import duckdb
import pytest

from arbitra.llm.oracle import SQL
from arbitra.llm.queries import QUERIES
from arbitra.llm.threads import link_quotations

ROWS = [
    (1, 0, "u", "Hello there my friend\nsecond line here"), (1, 1, "a", "an answer to that"), (1, 2, "u", "> HELLO there   my friend\n> second line here\nI do agree"), (1, 3, "a", ">> Hello there my friend\n> I do agree\nmine"),
    (1, 4, "u", "> an answer to\nno such line"), (2, 0, "u", "  > an answer to that\nwow"), (2, 1, "u", None), (2, 2, "u", ""), (2, 3, "u", "> > deep\n>flat words"), (2, 4, "u", "a > b"), (2, 5, "u", "> mine\n> I do agree\n\nlast\n> wow and more\nend"),
    (3, 1, "u", "first to say this"), (3, 2, "u", "> first to say this\nyes it was"), (3, 5, "u", "> yes it was\n> first to say this\nok then so"), (3, 9, "u", "> ok then so\nend"),
    (4, 0, "u", "alpha beta gamma words"), (4, 1, "a", ">> Alpha beta  gamma words\nnothing on the first level"), (4, 2, "u", "Yes."), (4, 3, "a", "> yes.\nthat is a good thing"), (4, 4, "u", "> never said by anyone\n>> that is a good thing\n>>> Yes.\nmore of it"), (5, 0, "u", "> Yes.\nin another conversation"),
]


def order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda t: [(x is None, str(x)) for x in t])


def test_quotations(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    sql, got = con.sql(SQL["op7_chat_formatting"]), link_quotations(df)
    assert order(got.columns, got.collect()) == order(sql.columns, sql.fetchall())
    links = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_linked"]) for r in got.collect()}
    assert links[4, 1] == (0, 1) and links[4, 3] == (2, 1) and links[4, 4] == (3, 2) and links[5, 0] == (None, 0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_table(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    sql, got = con.sql(SQL[name]), QUERIES[name](spark, sf)
    rows = got.collect()
    assert order(got.columns, rows) == order(sql.columns, sql.fetchall())
    if not name.startswith("op7_"):
        return
    place = [(r["conv_id"], r["thread"], r["turn"]) for r in rows]
    assert place == sorted(place)
    assert name != "op7_quoted_conversations" or sum(r["reply_to"] is not None for r in rows) > 10
