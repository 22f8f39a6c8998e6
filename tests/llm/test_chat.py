from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import chat

from .common import with_clashes

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NAME]", "[TURN]", "\\", "<", "[", ">", "]", "/", "s", " ", "\n", "x", "é", "$1", "INST]"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    turns = [(r or "", t or "") for _, _, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[NAME]", "", None]), st.one_of(st.none(), TEXT)), min_size=1, max_size=8))
def test_any_conversation_reads_back(spark, turns):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == want(rows)


def test_template(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c</s>"), (1, 0, "system", "s"), (1, 4, "tool", "t")]
    got = chat.format_conversations(with_clashes(spark.createDataFrame(rows, SCHEMA))).first()["formatted"]
    assert got == "<s><<SYS>>s<</SYS>>[INST] a[TURN]b [/INST]c<\\/s></s>[ROLE]tool[NAME]t[/ROLE]"


def test_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "n"), (None, 0, "user", "z"), (None, 1, "assistant", None)]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == want([r for r in rows if r[0] == 1])[1]
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 0
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation_and_no_python(spark):
    rows = [(7, k, "user" if k % 3 else "assistant", "x" * (k % 50)) for k in range(3000)]
    found = chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert (found.first()["n_turns"], found.first()["turns_sha256"]) == want(rows)[:2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
