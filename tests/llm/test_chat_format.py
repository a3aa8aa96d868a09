import hashlib

from pyspark.sql import functions as F

from groundwork.llm import chat_format as c

SAYINGS = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\b", "<|turn|>user\n<|end|>\n", "<\\|turn|>", "<<s>>", "<|end|", "<|turn|><|turn|>", "a\nb\r\n\n", "[\\INST]", "[[INST]INST]",
           "ü<|end|>\\n", "<|end|>\n" * 3, "\\" * 5 + "<s>"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")


def test_round_trip(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", text) for k, text in enumerate(SAYINGS)]
    rows += [(2, k, role, "t") for k, role in enumerate(SAYINGS)]  # roles may hold anything too
    rows += [(3, 0, None, None), (3, None, "user", "first"), (None, 0, "user", "no id"), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (5, 0, "user", "long " * 100_000)]
    out = c.formatted(table(spark, rows))
    got = {r["conv_id"]: r for r in out.withColumn("back", c.read_turns(F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        r = got[conv]
        assert [(b["role"], b["text"]) for b in r["back"]] == [t[2:] for t in turns]
        assert r["n_turns"] == len(turns) and r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert sum(s["loss"] for s in r["segments"]) == sum(t[2] == "assistant" for t in turns)
    # Control strings stand only where the template puts them.
    assert got[1]["formatted"].count("<|turn|>") == len(SAYINGS) and "[INST]" not in got[1]["formatted"] and "</s>" not in got[1]["formatted"]


def test_machine(spark):
    cases = {"ua": None, "sua": None, "uaua": None, "u": 1, "": None, "a": 0, "uu": 1, "sus": 2, "ss": 1, "uat": None, "uata": None, "ux": 1, "uaa": 2}
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool", "x": "other"}
    rows = [(k, n, names[r], "hi") for k, roles in enumerate(cases) for n, r in enumerate(roles)]
    got = {r["conv_id"]: r["fault_turn"] for r in c.formatted(table(spark, rows)).collect()}
    assert got == {k: fault for k, (roles, fault) in enumerate(cases.items()) if roles}


def test_loss_is_each_assistant_text_once(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<s>é\\"), (1, 2, "assistant", "b"), (1, 3, "user", "z")]
    r = c.formatted(table(spark, rows)).select(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: c.unescaped(s.text, c.TEMPLATE)), "").alias("x")).first()
    assert r["x"] == "<s>é\\b" and hashlib.sha256(r["x"].encode()).hexdigest()


def test_empty_table(spark):
    assert c.formatted(table(spark, [])).count() == 0
