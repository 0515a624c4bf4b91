import hashlib
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsengine.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def rows():
    rng = random.Random(0)
    said = lambda: "".join(rng.choices(["word ", "\\", "###", "</turn>", "<\\/turn>", "\n", "#", ":", "é😀", "</turn", "### Assistant: "], k=rng.randint(0, 60)))
    out = []
    for c in range(40):
        n = rng.randint(1, 30)
        if rng.random() < 0.5:
            out.append((c, 0, "system", said(), ""))
        out += [(c, k, "user" if k % 2 else "assistant", said(), "clash") for k in range(1, n)]
    out += [(50, 0, "user", None, ""), (50, 1, "assistant", None, ""), (51, None, None, "x", ""), (51, 0, "ro:\nle#", "y", ""), (52, 0, "assistant", "same", ""), (52, 0, "assistant", "same", ""), (None, 0, "user", "z", ""), (53, 0, "assistant", "long " * 50000, "")]
    return out


def want(rows):
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_is_the_conversation(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for budget, history in ((512, 128), (60, 30), (20, 0), (1, 0)):
        windows = chat.windows(df, budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
        assert got == want(rows())


def test_windows_keep_system_history_and_budget(spark):
    out = defaultdict(list)
    for r in chat.windows(spark.createDataFrame(rows(), SCHEMA), 80, 30).collect():
        out[r.conv_id].append(r)
    assert max(map(len, out.values())) > 3
    parsed = lambda r: [tuple(t) for t in r["t"]]
    df = spark.createDataFrame([r for rs in out.values() for r in rs]).withColumn("t", chat.parsed(F.col("formatted")))
    for conv in {r.conv_id for r in df.select("conv_id").collect()}:
        own = sorted((r for r in df.collect() if r.conv_id == conv), key=lambda r: r.window)
        assert [r.window for r in own] == list(range(len(own)))
        first = parsed(own[0])[0]
        for before, r in zip(own, own[1:], strict=False):
            turns = parsed(r)
            lead = turns[: r.turns_before]
            if first[0] == "system":
                assert lead[0] == first
                lead = lead[1:]
            assert not lead or parsed(before)[-len(lead) :] == lead
            assert len(r.loss) == sum(t[0] == "assistant" for t in turns[r.turns_before :])
        for r in own:
            assert len(parsed(r)) == r.turns_before + r.turns_new


def test_windows_keep_to_the_budget(spark):
    count = lambda text: len(re.findall(r"[^\W_]+|[^\s\w]|_", text))
    df = spark.createDataFrame(rows(), SCHEMA)
    longest = {}
    for c, _, role, text, _ in rows():
        longest.setdefault(c, []).append((role, count(text or "")))
    for budget, history in ((512, 128), (80, 30), (40, 39)):
        for r in chat.windows(df, budget, history).withColumn("t", chat.parsed(F.col("formatted"))).collect():
            sizes = [count(t) for _, t in r.t]
            system = sizes[0] if r.t[0][0] == "system" else 0
            assert r.n_tokens == sum(sizes)
            own = sizes[r.turns_before :] if r.window else sizes[bool(system) :]
            if system + max(own, default=0) <= budget and system + 1 <= budget - history or len(own) == 1 and system + own[0] <= budget:
                assert r.n_tokens <= budget
            else:
                assert len(own) == 1 or system >= budget - history
            assert sum(sizes[: r.turns_before]) - (system if r.window else 0) <= history


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\#</turn>:\nab"), max_size=20), min_size=1, max_size=40))
def test_escape_is_reversible_and_hides_controls(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert "###" not in r.e and "</turn>" not in r.e


def test_empty_table_and_native_plan(spark):
    df = chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA)))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
