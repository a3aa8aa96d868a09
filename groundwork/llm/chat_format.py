"""Chat formatting: a state machine over roles, and segments with loss flags from a declarative template.

All work is done by built-in functions on one row per conversation. A conversation's text
has to be one value in the end (it is hashed and trained on as one), so its turns meet in
one row; turns are gathered, never paired.

Turns are sorted by (turn, role, text), nulls first; equal rows all stay. A null role or
text counts as empty. The machine reports the place of the first turn whose role its state
does not allow (`fault_turn`, from 0), or that the conversation ends in a state that is not
final (`fault_turn` = number of turns); such conversations are formatted all the same. A null
conv_id is a conversation of its own. Other columns of the input are not read.
"""

from pyspark.sql import functions as F

from groundwork.llm import shared

#: The declarative template. {role} and {text} are escaped; loss: roles whose text is learned.
TEMPLATE = {
    "open": "<|turn|>",
    "role_end": "\n",
    "close": "<|end|>\n",
    "loss": ("assistant",),
    # Strings that a text must not contain as they are: marks of this and of other templates.
    "control": ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
    "start": "start",
    "final": ("assistant", "tool"),
    # state: {role: next state}
    "moves": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant"},
    },
}

ESCAPE = "\\"


def _replaced(text, old, new):
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text, template):
    """Reversible: the escape sign becomes `\\b`, and a sign is put behind the first character of each control string."""
    text = _replaced(text, ESCAPE, ESCAPE + "b")
    for mark in template["control"]:
        text = _replaced(text, mark, mark[0] + ESCAPE + mark[1:])
    return text


def unescaped(text, template):
    for mark in reversed(template["control"]):
        text = _replaced(text, mark[0] + ESCAPE + mark[1:], mark)
    return _replaced(text, ESCAPE + "b", ESCAPE)


def escaped_role(role, template):
    """A role stands before a line break, so it must not contain one."""
    return _replaced(escaped(role, template), template["role_end"], ESCAPE + "n")


def unescaped_role(role, template):
    return unescaped(_replaced(role, ESCAPE + "n", template["role_end"]), template)


def conversations(rows):
    """One row per conversation with its turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"))


def fault_turn(turns, template):
    """Place of the first turn the machine refuses; the number of turns if it ends too early; else null."""
    moves = F.create_map(*[F.lit(x) for state, by_role in template["moves"].items() for role, after in by_role.items()
                           for x in (f"{state}\n{role}", after)])
    begin = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault"))

    def step(acc, turn):
        after = F.when(acc.fault.isNull(), F.try_element_at(moves, F.concat(acc.state, F.lit("\n"), turn.role)))
        return F.struct(F.coalesce(after, acc.state).alias("state"), (acc["at"] + 1).alias("at"),
                        F.coalesce(acc.fault, F.when(after.isNull(), acc["at"])).alias("fault"))

    def end(acc):
        return F.coalesce(acc.fault, F.when(~acc.state.isin(*template["final"]), acc["at"]))
    return F.aggregate(turns, begin, step, end)


def segments(turns, template):
    """(text, loss) in order: marks and roles never under loss, texts of the loss roles always."""
    def of(turn):
        loss = turn.role.isin(*template["loss"])
        return F.array(
            F.struct(F.concat(F.lit(template["open"]), escaped_role(turn.role, template), F.lit(template["role_end"])).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn.text, template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")))
    return F.flatten(F.transform(turns, of))


def formatted(rows, template=TEMPLATE):
    """conv_id, n_turns, fault_turn, segments (text, loss) and their concatenation `formatted`."""
    out = conversations(rows).select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                                     fault_turn(F.col("turns"), template).alias("fault_turn"), segments(F.col("turns"), template).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def read_turns(text, template=TEMPLATE):
    """Turns (role, text) read back from a formatted string."""
    pieces = F.split(text, "\\Q" + template["open"] + "\\E")
    def turn(piece):
        at = F.instr(piece, template["role_end"])
        body = piece.substr(at + len(template["role_end"]), F.length(piece) - at - (len(template["role_end"]) - 1) - len(template["close"]))
        return F.struct(unescaped_role(piece.substr(F.lit(1), at - 1), template).alias("role"), unescaped(body, template).alias("text"))
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def op10_chat_format(spark, sf_dir):
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
                                  F.lit(said).alias("text"))
    out = formatted(rows.unionByName(extra.withColumn("turn", F.col("turn").cast("long"))))
    said_back = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescaped(s.text, TEMPLATE)), "")
    out = out.withColumn("__learned", learned)
    return out.select("conv_id", "n_turns", F.sha2(said_back, 256).alias("turns_sha256"), F.length("__learned").cast("long").alias("loss_chars"),
                      F.sha2("__learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
                      F.col("fault_turn").cast("long").alias("fault_turn"))


QUERIES = {"op10_chat_format": op10_chat_format}


def _sql_escaped(column):
    column = f"replace({column}, '\\', '\\b')"
    for mark in TEMPLATE["control"]:
        column = f"replace({column}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return column


_FIXED = len(TEMPLATE["open"]) + len(TEMPLATE["role_end"]) + len(TEMPLATE["close"])
_MOVES = ", ".join(f"('{state}', '{role}', '{after}')" for state, by_role in TEMPLATE["moves"].items() for role, after in by_role.items())
_FINAL = ", ".join(f"'{state}'" for state in TEMPLATE["final"])

ORACLES = {"op10_chat_format": f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM said),
moves(state, role, after) AS (VALUES {_MOVES}),
-- Every state is named after the role that leads to it, so the role before is the state.
judged AS (SELECT p.*, m.after IS NULL AS refused FROM placed p LEFT JOIN moves m ON m.state = coalesce(p.before, 'start') AND m.role = p.role)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_FIXED} + length(replace({_sql_escaped('role')}, chr(10), '\\n')) + length({_sql_escaped('text')}))::BIGINT AS formatted_chars,
  coalesce(min(place) FILTER (refused), CASE WHEN arg_max(role, place) NOT IN ({_FINAL}) THEN count(*) END) AS fault_turn
FROM judged GROUP BY conv_id
"""}
