import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.llm.chat import (
    CONTROLS,
    assemble,
    escape,
    format_turns,
    read_turn,
    render,
    reserved,
    unescape,
)
from lodeworks.llm.queries import INTRUDER, QUERIES

ROWS = [
    (1, 1, "assistant", "héllo\nworld <|im_end|>"),
    (1, 0, "system", "be <\\|im_start|> kind"),
    (1, 2, "assistant", "again"),
    (2, 0, "user", None),
    (2, 0, "assistant", ""),
    (None, 0, None, "lost"),
    (3, 0, "assistant", "x" * 200000),
    (4, 0, "user", "twice"),
    (4, 0, "user", "twice"),
    (5, 0, "odd\nrole<|im_sep|>", "漢字 <|im_sep|>"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_reads_back_every_conversation(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df.withColumn("ids", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op6_chat_formatting"](spark, str(tmp_path)).collect()}
    want = {}
    for conv, _, role, text in sorted(ROWS, key=lambda r: (r[0] or 0, r[1])):
        want.setdefault(conv, []).append((role or "", text or ""))
    want[-1] = [("user", INTRUDER), ("assistant", INTRUDER)]
    assert set(got) == set(want)
    for conv, turns in want.items():
        orders = [turns, turns[::-1]] if conv == 2 else [turns]
        assert got[conv].turns_sha256 in {sha("".join(f"{r}\n{t}\n" for r, t in o)) for o in orders}
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(loss))
        assert got[conv].loss_sha256 == sha(loss)
        rendered = sum(len(escape(r) + escape(t)) + sum(map(len, CONTROLS)) for r, t in turns)
        assert got[conv].formatted_chars == rendered


def test_rendered_text_has_no_foreign_controls(spark):
    df = spark.createDataFrame([(1, 0, "user", INTRUDER)], "conv_id long, turn long, role string, text string")
    row = format_turns(df).first()
    assert render(row.ids).count("<|im_end|>") == 1
    assert sum(i in reserved("byte_bpe_50k").values() for i in row.ids) == 3 and not any(row["mask"])
    assert format_turns(df.limit(0)).count() == 0


pieces = st.lists(
    st.sampled_from([*CONTROLS, "<", "\\", "|", "|>", "im_end", "a", "\n", "é"]), max_size=12
).map("".join)


@settings(max_examples=150, deadline=None)
@given(pieces, st.sampled_from(["user", "assistant"]))
def test_escape_and_assembly_are_reversible(text, role):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)
    ids, mask, ends = assemble([(role, text)], "byte_bpe_50k")
    assert read_turn(ids, mask, "byte_bpe_50k") == (role, text, text if role == "assistant" else "")
    assert list(ends) == [len(ids)]
