import hashlib
import random

from pyspark.sql import functions as F

from ledgerlens.llm import chat as C

from .oracle import same


def test_query_equals_sql(spark):
    same(spark, "op10_chat_format")


def plain(turns):
    """Formatted text and loss text, in plain Python."""
    def esc(t):
        return t.replace("\\", "\\\\").replace("<|", "<\\|")

    out, before = "", None
    for role, text in turns:
        if before is not None and role == before:
            out += "<|next|>" + esc(text)
        else:
            out += ("<|end|>" if before is not None else "") + f"<|start|>{esc(role)}<|text|>" + esc(text)
        before = role
    return out + "<|end|>"


def test_round_trip_with_hostile_texts_nulls_ties_and_long_conversations(spark):
    rng = random.Random(2)
    bits = ["<|", "\\", "<\\|", "<|end|>", "<|next|>", "<|text|>", "<|start|>", "é🙂", "a", "", "\n", "|", "<", "\\\\<|"]
    rows = []
    for conv in range(12):
        for turn in range(rng.choice([1, 3, 255, 256, 257, 700])):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "<|end|>", "system"]), "".join(rng.choices(bits, k=rng.randrange(0, 6)))))
    rows += [(50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (51, None, "user", "last"), (51, 3, None, None), (51, 1, "assistant", None), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "pieces": F.lit(2), "none": F.lit(True), "run": F.lit(0)})
    made = C.format_conversations(df.repartition(5)).select("conv_id", "pieces", C.formatted_text().alias("formatted"), C.read_turns(C.formatted_text()).alias("turns"), C.read_loss(F.col("pieces")).alias("loss")).collect()
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in made} == set(by) and len(made) == len(by)
    for r in made:
        turns = [(role, text) for _, _, role, text in sorted(by[r.conv_id], key=lambda t: (t[0], t[1], t[2].replace("\\", "\\\\").replace("<|", "<\\|"), t[3].replace("\\", "\\\\").replace("<|", "<\\|")))]
        assert r.formatted == plain(turns)
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        for p in r.pieces:
            assert all(0 <= s.start and s.start + s.length <= len(p.text) for s in p.loss)


def test_no_python_in_the_plan(spark):
    from ledgerlens.llm.queries import QUERIES

    plan = QUERIES["op10_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_added_conversation(spark):
    from ledgerlens.llm.queries import QUERIES

    row = [r for r in QUERIES["op10_chat_format"](spark, "/root/testdata/sf0.001").collect() if r.conv_id == -7][0]
    text = "\\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_very_many_turns_without_a_number_are_cut_into_runs(spark):
    n = 3 * C.RUN + 5
    rows = [(1, None, "user" if i % 3 else "assistant", f"t{i:05d} <| \\") for i in range(n)] + [(2, 7, "assistant", f"same {i:04d}") for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = C.format_conversations(df).select("conv_id", F.size("pieces").alias("k"), C.read_turns(C.formatted_text()).alias("turns"), C.read_loss(F.col("pieces")).alias("loss"))
    got = {r.conv_id: r for r in made.collect()}
    want = sorted((r[2], r[3]) for r in rows if r[0] == 1)
    assert [tuple(t) for t in got[1].turns] == want and got[1].k == 4
    assert got[1].loss == "".join(t for r, t in want if r == "assistant")
    assert got[2].loss == "".join(f"same {i:04d}" for i in range(n)) and got[2].k == 4
