import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.chat_format import chat_format, masked_text, parse

SCHEMA = "conv_id long, turn long, role string, text string"
alphabet = st.sampled_from(["a", "\n", "<", "|", ">", "\\", "n", "im_end", "<|im_end|>", "<|im_start|>", "<\\|", "<n|", "é", "\r", "$1", " "])
piece = st.lists(alphabet, max_size=8).map("".join)


def check(spark, rows):
    out = chat_format(spark.createDataFrame(rows, SCHEMA).withColumn("piece", F.lit("clash")).withColumn("c", F.lit(1)))
    out = out.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [t[2:] for t in turns]
        assert got[c].n_turns == len(turns)
        assert got[c].loss == "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c].formatted.count("<|im_end|>") == len(turns)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 2, None]), st.sampled_from(["user", "assistant", None, "a\nb", "<n|", "<|x"]), st.one_of(st.none(), piece)), min_size=1, max_size=25))
def test_round_trip(spark, rows):
    check(spark, rows)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain < text | here"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (2, 0, "user", "x" * 300_000)]
    check(spark, rows)
    out = {r.conv_id: r.formatted for r in chat_format(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "plain < text | here<|im_end|>" in out[1] and "<\\|im_end|>" in out[1]
    assert hashlib.sha256(out[2].encode()).hexdigest() == hashlib.sha256(f"<|im_start|>user\n{'x' * 300_000}<|im_end|>\n".encode()).hexdigest()


def test_empty(spark):
    assert chat_format(spark.createDataFrame([], SCHEMA)).count() == 0
