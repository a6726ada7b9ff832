import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagmill import constants as K
from tagmill.functions import prompts, replies, scores, text as tx
from tagmill.operators import cleaning

SPACES = ["a b", " x ", "\x1fx\x1c", "\x0bx\x85", "  x ", "x\ty", ""]


def test_strip_equals_python(spark):
    frame = spark.createDataFrame([(s,) for s in SPACES], "s string")
    assert [r[0] for r in frame.select(tx.strip_space(F.col("s"))).collect()] == [s.strip() for s in SPACES]


def plain_verdict(reply):
    if reply is None:
        return False, 0.0
    low = reply.strip().lower()
    yes, no = "true" in low, "false" in low
    return (yes, 0.8) if yes != no else (False, 0.3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["TRUE.", "true or false", "", " False\n", "indeterminate", "untrue"]), st.text(max_size=8)), min_size=1, max_size=20))
def test_verdict(spark, given_replies):
    frame = spark.createDataFrame(list(enumerate(given_replies)), "i int, r string")
    found = frame.select("i", replies.verdict(F.col("r")).alias("v")).orderBy("i").collect()
    assert [(r["v"]["is_valid"], r["v"]["confidence"]) for r in found] == [plain_verdict(r) for r in given_replies]


def test_reply_forms(spark):
    payloads = [
        {"candidates": [{"content": {"parts": [{"text": " a "}]}}]}, {"content": [{"text": "<think></think> True"}]},
        {"choices": [{"message": {"content": "c"}}]}, {"text": "d"}, {"error": 1},
    ]
    frame = spark.createDataFrame([(json.dumps(p),) for p in payloads] + [("not json",)], "p string")
    assert [r[0] for r in frame.select(replies.decode_reply(F.col("p"))).collect()] == ["a", "True", "c", "d", K.UNREADABLE_REPLY, K.UNREADABLE_REPLY]


def test_entropy_and_proxy(spark):
    frame = spark.createDataFrame([([0.5, 0.5, 0.0, 0.0],), ([1.0, 0.0],)], "p array<double>")
    assert [r[0] for r in frame.select(scores.entropy_bits(F.col("p"))).collect()] == pytest.approx([1.0, 0.0])
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    row = spark.range(1).select(scores.proxy_probabilities(F.lit("b"), labels).alias("k"), scores.proxy_probabilities(F.lit("q"), labels).alias("u")).first()
    assert row["k"] == pytest.approx([0.05, 0.9, 0.05]) and row["u"] == [0.0, 0.0, 0.0]
    assert math.isclose(sum(row["k"]), 1.0)


def test_braces_in_a_text_are_kept(spark):
    frame = spark.createDataFrame([("{label} {text}", "x")], "t string, l string")
    empty = F.array().cast("array<string>")
    found = frame.select(prompts.binary_prompt(F.col("t"), F.col("l"), F.lit("d"), empty, 6)).first()[0]
    assert found == K.BINARY_TEMPLATE.format(text="{label} {text}", label="x", description="d", examples_section="")


def test_examples_are_numbered_and_cut(spark):
    row = spark.range(1).select(prompts.examples_section(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)).first()[0]
    assert row == 'Representative Examples:\n1. "a"\n2. "b"\n\n'


def test_request_styles(spark):
    frame = spark.createDataFrame([('say "hi"\n',)], "t string")
    found = [json.loads(frame.select(prompts.chat_request("sys", F.col("t"), s, (("q", "a"),))).first()[0]) for s in ("messages", "single", "contents")]
    assert [m["role"] for m in found[0]["messages"]] == ["system", "user", "assistant", "user"]
    assert found[1]["messages"] == [{"role": "user", "content": 'System: sys\n\nHuman: q\n\nAssistant: a\n\nHuman: say "hi"\n'}]
    assert found[2]["contents"][-1] == {"role": "user", "parts": [{"text": 'say "hi"\n'}]}
    with pytest.raises(ValueError):
        prompts.chat_request("s", F.col("t"), "other")


def test_dirty_rows_are_rejected_by_row(spark):
    rows = [(1, None, "a"), (2, "x", "  "), (3, " y ", "b "), (4, "nan", "c"), (5, " ", None)]
    kept, rejected = cleaning.clean_rows(spark.createDataFrame(rows, "row_id long, text string, label string"))
    assert {(r["row_id"], r["text"], r["label"]) for r in kept.collect()} == {(3, "y", "b"), (4, "nan", "c")}
    assert {r["row_id"]: r["rejected"] for r in rejected.collect()} == {1: "text", 2: "label", 5: "text"}
    with pytest.raises(ValueError):
        cleaning.clean_rows(spark.createDataFrame(rows, "row_id long, text string, label string"), strict=True)


def test_tokens_and_pairs(spark):
    words = spark.range(1).select(tx.without(tx.tokens(F.lit("The Été a x_1 the 中文")), ["the"]).alias("w"))
    found = words.select("w", tx.with_pairs(F.col("w")).alias("t")).first()
    assert found["w"] == ["été", "x_1", "中文"] and found["t"] == ["été", "x_1", "中文", "été x_1", "x_1 中文"]
    assert spark.range(1).select(tx.with_pairs(tx.tokens(F.lit("a")))).first()[0] == []
    assert spark.range(1).select(tx.truncate(F.lit("abcdef"), 3)).first()[0] == "abc..."
