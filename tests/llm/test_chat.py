import duckdb

from terracell.llm import chat
from terracell.llm.queries import SQL


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_common_prefix_is_rendered_once(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "More"), (1, 3, "assistant", "A long answer")]
    rows += [(2, 0, "user", "Hi"), (2, 1, "assistant", "Hello"), (2, 2, "user", "More"), (2, 3, "assistant", "No")]
    r = chat.preferences(turns(spark, rows).selectExpr("*", "'x' as first", "1 as block")).first()
    assert (r["chosen_conv"], r["rejected_conv"], r["n_common"]) == (1, 2, 3)
    assert r["prompt"] == "<|user|>\nHi<|end|>\n<|assistant|>\nHello<|end|>\n<|user|>\nMore<|end|>\n"
    assert r["chosen"] == "<|assistant|>\nA long answer<|end|>\n" and r["rejected"] == "<|assistant|>\nNo<|end|>\n"
    a, b = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][a:b] == "A long answer<|end|>"


ODD = [
    (1, 0, "user", "q"), (1, 1, "assistant", "x"), (2, 0, "user", "q"), (2, 1, "assistant", "x"), (3, 0, "user", "q"), (4, None, None, None), (4, 1, "assistant", "say <|user|> é"),
    (5, 0, "user", "q"), (5, 0, "user", "q"), (5, 0, "user", "r"), (None, 0, "user", "q"), (6, 0, "system", ""), (7, 0, "system", ""), (7, 1, "assistant", ""), (8, 0, "user", "long " * 9000),
]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    r = con.execute(SQL["op3_chat_preferences"])
    names = [d[0] for d in r.description]
    return sorted((tuple(x) for x in r.fetchall()), key=str), names


def test_equals_sql_on_odd_rows(spark):
    rows = ODD + [(100 + i, 0, "user", "same first turn") for i in range(41)] + [(100 + i, 1, "assistant", "a" * (i % 5)) for i in range(41)]
    want, names = by_sql(rows)
    got = chat.preferences(turns(spark, rows).repartition(3)).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_blocks_do_not_change_pairs(spark, monkeypatch):
    rows = [(i, 0, "user", "same") for i in range(50)]
    want = sorted(map(str, chat.preferences(turns(spark, rows)).collect()))
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(map(str, chat.preferences(turns(spark, rows)).collect())) == want


def test_empty(spark):
    assert chat.preferences(turns(spark, [])).count() == 0
