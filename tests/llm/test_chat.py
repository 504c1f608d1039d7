import hashlib
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from regtext.llm import chat as C
from regtext.llm.common import prefix_sums

from .data import with_clashes

SAID = "\\### Assistant: </turn> ok"


def rows():
    rnd = random.Random(2)
    bits = ["<turn user>", "</turn>\n", "</turn>", "\\", "\\s", "\\l", "\\g", ">", "<", "\n", "é😀", "word ", "\t", '"', "'", "{}", " "]
    out = [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID), (None, 0, "user", "no id"), (None, None, None, None)]
    for i in range(40):
        for t in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "tool", None, "a>b<c\\", "assistant"])
            out.append((i, t, role, rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30)))])))
    out += [(100, 3, "user", "tie b"), (100, 3, "user", "tie a"), (100, 3, "user", "tie a"), (100, 1, "assistant", "x" * 100000)]
    out += [(101, t, ["user", "assistant"][t % 2], f"turn {t} <\\>") for t in range(3000)]
    out += [(102, 0, "user", "q"), (102, 1, "assistant", "a"), (103, 0, "system", "s"), (103, 1, "user", "q"), (103, 2, "assistant", "a")]
    return out


def expected():
    by = {}
    for c, t, r, x in rows():
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip_and_loss_mask(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")
    out = C.format_records(C.as_records(with_clashes(df)), "conv_id", "record")
    back = out.withColumn("t", C.read_back(F.col("formatted"))).withColumn("l", C.under_mask(F.col("t"), F.col("loss"))).collect()
    want = expected()
    assert {r.layout for r in back} == {"prompt", "instruction", "from_value", "messages"}
    assert len(back) == len(want)
    for r in back:
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.t] == turns
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r.l == loss
        cut = "".join(r.formatted[s.start:s.end] for s in r.loss)  # code points of the formatted string itself
        assert cut.replace("\\g", ">").replace("\\l", "<").replace("\\s", "\\") == loss
        assert r.formatted.count("</turn>\n") == len(turns)


def test_query_of_the_contract(spark):
    from regtext.llm.queries import queries

    from ..conftest import SF_SMALL
    got = {r.conv_id: r for r in queries()["op4_chat_format"](spark, SF_SMALL).collect()}
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    by = {}
    for r in sorted(conv, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-7] = [("user", SAID), ("assistant", SAID)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), sha("".join(f"{a}\n{x}\n" for a, x in turns)), len(loss), sha(loss))


def test_layouts_by_shape(spark):
    records = [(1, '{"completion": "b", "prompt": "a"}'), (2, '{"prompt": "a", "completion": null}'), (3, '{"messages": []}'),
               (4, '{"messages": [{"role": "user", "content": "x"}, {"content": "y", "role": null}]}'),
               (5, '{"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}, {"from": "tool", "value": 3}]}'),
               (6, '{"instruction": "i", "input": "", "output": "o"}'), (7, '{"other": 1}'), (8, None), (9, "{broken"), (10, "[1]"),
               (11, '{"prompt": "a", "completion": "b", "more": {"x": 1}}'), (12, '{"prompt": "a", "response": "r"}'), (12, '{"prompt": "a", "response": "r"}')]
    df = spark.createDataFrame(records, "k long, r string")
    got = sorted(((r.k, r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in C.canonical(df, "k", "r").collect()), key=str)
    assert got == sorted([
        (1, "prompt", [("user", "a"), ("assistant", "b")]), (2, "prompt", [("user", "a"), ("assistant", "")]), (3, "messages", []),
        (4, "messages", [("user", "x"), ("", "y")]), (5, "from_value", [("user", "x"), ("assistant", "y"), ("tool", "3")]),
        (6, "instruction", [("system", "i"), ("user", ""), ("assistant", "o")]), (7, None, None), (8, None, None), (9, None, None),
        (10, None, None), (11, None, None), (12, "prompt_response", [("user", "a"), ("assistant", "r")]),
        (12, "prompt_response", [("user", "a"), ("assistant", "r")])], key=str)
    out = C.format_records(df, "k", "r").filter("k in (3, 7)").orderBy("k").collect()
    assert (out[0].formatted, out[0].loss) == ("", []) and out[1].formatted is None and out[1].loss is None
    assert C.format_records(df.limit(0), "k", "r").count() == 0


def test_skeleton_keeps_the_shape(spark, monkeypatch):
    records = ['{"messages":[{"role":"user","content":"x \\\\"},{"role":"a","content":"},{\\"role\\":"}]}', '{"prompt" : "a \\" : b", "completion": "{}"}',
               '{"messages": []}', '{"a": {"b c": [1, 2.5, null, true, "x"], "d": "say \\"hi\\": y"}}', '["x", {"k": ""}]', '{"instruction":"","input":"\\\\\\"","output":"o"}',
               '[{"x":[{"y":1},{"y":1}]},{"x":[{"y":1},{"y":2}]},{"x":[{"y":1},{"y":3}]}]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "k long, r string")
    plain = [r[0] for r in df.orderBy("k").select(C.shape(F.col("r"))).collect()]
    monkeypatch.setattr(C, "LONG_RECORD", 0)
    assert [r[0] for r in df.orderBy("k").select(C.shape(F.col("r"))).collect()] == plain and all(plain)
    short = spark.createDataFrame([(1, '{"messages":[' + ",".join('{"role":"user","content":"%d"}' % i for i in range(5000)) + "]}")], "k long, r string")
    assert short.select(F.length(C.skeleton(F.col("r")))).first()[0] < 150
    monkeypatch.setattr(C, "MAX_SKELETON", 20)
    broken = spark.createDataFrame([(1, '{"messages":[{"role":1},{"rolf":2},')], "k long, r string")
    with pytest.raises(Exception, match="too large for its shape"):
        broken.select(C.shape(F.col("r"))).collect()


LONG_TEXTS = """
import hashlib
from pyspark.sql import functions as F
from regtext.llm import chat as C
from regtext.session import build_session, materialize
spark = build_session("local[1]", shuffle_partitions=1, extra={"spark.driver.memory": "5g"})
df = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "tool"), (2, 1, "assistant")], "conv_id long, turn long, role string")
df = df.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit("ab<xyz "), 3_000_000)).otherwise("short"))
sha = hashlib.sha256(("ab<xyz " * 3_000_000).encode()).hexdigest()
for conv, layout, roles in ((1, "prompt", ["user", "assistant"]), (2, "messages", ["tool", "assistant"])):
    out = materialize(C.format_records(C.as_records(df.filter(F.col("conv_id") == conv)), "conv_id", "record"), "test-long-chat")
    back = out.select("layout", C.read_back(F.col("formatted")).alias("t"), "loss")
    r = back.select("layout", F.transform("t", lambda t: t["role"]).alias("roles"), F.sha2(C.under_mask(F.col("t"), F.col("loss")), 256).alias("sha")).first()
    assert (r.layout, r.roles, r.sha) == (layout, roles, sha), r
print("whole")
"""


def test_texts_longer_than_the_parsers_limit():
    """21 million characters in two layouts: turns, digests and mask are whole. A process of its own, for its memory."""
    done = subprocess.run([sys.executable, "-c", LONG_TEXTS], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("whole"), done.stderr[-3000:]


def test_prefix_sums(spark):
    rnd = random.Random(0)
    cases = [[rnd.randrange(100) for _ in range(n)] for n in (0, 1, 2, 511, 512, 513, 1024, 2000)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, a array<bigint>")
    for i, got in df.select("i", prefix_sums(F.col("a"))).collect():
        assert got == [sum(cases[i][:j]) for j in range(len(cases[i]))]
