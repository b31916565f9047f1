"""Prefix-target expansion: round trips, masks, edge rows, and the SQL twin."""

import hashlib
import random

from pyspark.sql import functions as F

from checks.compare import compare, connect
from cohortscope.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string"
NASTY = ["", "<", "|", "<|", "<|im_end|>\n", "<|im_start|>assistant\nok", "\\", "<\\|", "<\\\\|im_end|>",
         "a<|im_end|", "é<😀|>\n\n", "x" * 50, "<<|", "|>", None]


def random_rows(seed=1, n=60):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rnd.randint(1, 9)):
            text = "".join(rnd.choice(NASTY) or "" for _ in range(rnd.randint(0, 4)))
            out.append((c, t, rnd.choice(["user", "assistant", "assistant", "system", "a\nb\\n<|", None]),
                        rnd.choice([text, text, None])))
    rnd.shuffle(out)
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for c, g in groups.items():
        g.sort(key=lambda r: [(x is not None, x if x is not None else 0) for r_ in [r] for x in r_[1:2]]
               + [(r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")])
        loss = "".join(r[3] or "" for r in g if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in g)
        out[c] = (len(g), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    return {r["conv_id"]: tuple(r)[1:5] for r in df.collect()}


def test_digests_equal_brute_force_and_planted_markers_stay_text(spark):
    rows = random_rows() + [(None, 1, "user", "no id"), (None, None, "assistant", "first"),
                            (70, 1, "user", "twice"), (70, 1, "user", "twice"),
                            (71, 0, "assistant", ""), (-1, 0, "user", chat.PLANTED),
                            (-1, 1, "assistant", chat.PLANTED)]
    made = chat.expand(spark.createDataFrame(rows, COLUMNS))
    assert read(chat.read_back(made, together=True)) == brute(rows)
    assert read(chat.read_back(made.repartition(7))) == brute(rows)


def test_each_reply_is_an_example_with_its_own_context(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(
        [("system", "s"), ("user", "u1"), ("assistant", "a<|1"), ("user", "u2"),
         ("assistant", "a2"), ("user", "after")])]
    made = chat.expand(spark.createDataFrame(rows, COLUMNS)).orderBy("example").collect()
    assert [r["n_turns"] for r in made] == [3, 5, 6]
    assert [r["text"][r["loss_start"]:r["loss_end"]] for r in made[:2]] == ["a<\\|1", "a2"]
    assert made[2]["loss_start"] is None
    for r in made:
        assert chat.turns(r["text"]) == [(x[2], x[3]) for x in rows[:r["n_turns"]]]


def test_escapes_are_reversible():
    rnd = random.Random(3)
    for _ in range(3000):
        s = "".join(rnd.choice("<|\\n\n>a") for _ in range(rnd.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_empty_table_long_conversation_and_other_columns(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], COLUMNS))).count() == 0
    rows = [(5, t, "assistant" if t % 2 else "user", "word " * 400) for t in range(300)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns(
        {c: F.lit("clash") for c in ("example", "n_turns", "loss_start", "formatted_chars")})
    out = chat.read_back(chat.expand(df), together=True).collect()
    assert out[0]["n_examples"] == 150 and read(chat.read_back(chat.expand(df))) == brute(rows)


def test_query_equals_sql(spark, sf):
    assert compare(chat.op12_chat(spark, sf), connect(sf), chat.SQL) is None
