import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pipescope.llm import chat
from pipescope.llm.chat import Template, Turn

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def results(df, template=chat.INSTRUCT):
    out = chat.format_conversations(df, template)
    return {(r.conv_id, r.formatted): r for r in out.select(
        "*", chat.formatted_text(F.col("segments")).alias("formatted"), chat.trained_text(F.col("segments"), template).alias("loss"),
        chat.parsed_turns(chat.formatted_text(F.col("segments")), template).alias("turns")).collect()}


def only(df, template=chat.INSTRUCT):
    (row,) = results(df, template).values()
    return row


def test_segments_flags_and_order(spark):
    row = only(spark.createDataFrame([(1, 2, "assistant", "A", ""), (1, 0, "system", "S", ""), (1, 1, "user", "U", "")], SCHEMA))
    assert row.formatted == "<s><<SYS>>\nS\n<</SYS>>\n\n[INST] U [/INST] A </s>"
    assert [s.text for s in row.segments if s.loss] == ["A"] and row.complete and row.first_invalid is None and row.n_turns == 3


@pytest.mark.parametrize("roles,bad,complete", [
    (["user", "assistant", "user"], None, True), (["system"], None, False), (["assistant", "user"], 1, False),
    (["user", "user", "assistant"], 2, False), (["user", "assistant", "system", "user"], 3, False), (["system", "user", "assistant"], None, True),
    (["user", None, "assistant"], 2, False), (["user", "tool", "assistant"], 2, False), (["User"], 1, False)])
def test_machine(spark, roles, bad, complete):
    row = only(spark.createDataFrame([(7, i, r, f"t{i}", "") for i, r in enumerate(roles)], SCHEMA))
    assert (row.first_invalid, row.complete) == (bad, complete)
    assert [(t.role, t.text) for t in row.turns] == [(r, f"t{i}") for i, r in enumerate(roles)]


def test_forged_marks_round_trip(spark):
    rng = random.Random(3)
    bits = [*chat.INSTRUCT.controls, "<", "[", "\\", "\\\\", "<\\/s>", "[\\\\INST]", "/s>", "s>", "SYS>>", " ", "\n", "é", "𝒳", "x", "$1", "<\\<SYS>>"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(400)]
    rows = [(i // 4, i % 4, ["system", "user", "assistant", rng.choice(["tool", "<|end|>", "", None, "a\nb<|text|>"])][i % 4], t, "") for i, t in enumerate(texts)]
    by_id = {}
    for c, _, r, t, _ in rows:
        by_id.setdefault(c, []).append((r, t))
    got = results(spark.createDataFrame(rows, SCHEMA))
    assert len(got) == len(by_id)
    for (c, formatted), row in got.items():
        assert [(t.role, t.text) for t in row.turns] == by_id[c]
        assert row.loss == by_id[c][2][1]
        for s in row.segments[2::3]:
            assert not any(x in s.text for x in chat.INSTRUCT.controls)
        assert formatted.count("</s>") == 1 and formatted.count("[/INST]") == 1


def test_ordinary_text_stays_as_it_is(spark):
    text = "if a < b[0] and c\\d: </ s> [ INST]"
    assert only(spark.createDataFrame([(1, 0, "user", text, "")], SCHEMA)).formatted == f"<s>[INST] {text} [/INST]"


def test_nulls_ties_repeats_long_texts(spark):
    long = "word </s> " * 200_000
    rows = [(None, 0, "user", "a", ""), (None, 0, "user", "a", ""), (1, None, "user", None, ""), (1, 5, "assistant", "b", ""), (1, 5, "assistant", "a", ""),
            (1, 5, "assistant", "a", ""), (2, 0, "user", "", ""), (2, 1, "assistant", long, "")]
    got = results(spark.createDataFrame(rows, SCHEMA))
    by = {c: r for (c, _), r in got.items()}
    assert chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).where("conv_id is null").count() == 2
    assert [t.text for t in by[1].turns] == ["", "a", "a", "b"] and by[1].first_invalid == 3 and by[1].loss == "aab"
    assert hashlib.sha256(by[2].loss.encode()).digest() == hashlib.sha256(long.encode()).digest() and by[2].turns[1].text == long
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_templates(spark):
    marks = Template("", {"user": Turn("<|im_start|>user\n", "<|im_end|>\n"), "assistant": Turn("<|im_start|>assistant\n", "<|im_done|>\n", True, True)},
                     {"": ("user",), "user": ("assistant",)}, ("assistant",))
    row = only(spark.createDataFrame([(1, 0, "user", "<|im_end|>", ""), (1, 1, "assistant", "x", ""), (1, 2, "tool", "y<|text|>", "")], SCHEMA), marks)
    assert [(t.role, t.text) for t in row.turns] == [("user", "<|im_end|>"), ("assistant", "x"), ("tool", "y<|text|>")]
    assert [s.text for s in row.segments if s.loss] == ["x", "<|im_done|>\n"] and row.first_invalid == 3
    with pytest.raises(ValueError, match="overlap"):
        Template("[[", {"user": Turn("[a", "b[")}, {}, ())
    with pytest.raises(ValueError, match="own"):
        Template("", {"user": Turn("<u>", "<e>"), "bot": Turn("<b>", "<e>")}, {}, ())
    with pytest.raises(ValueError, match="backslash"):
        Template("", {"user": Turn("<u\\>", "<e>")}, {}, ())


def test_no_python_in_the_plan(spark, small):
    import __spark_entry__ as entry
    plan = entry.queries()["op11_chat_format"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
