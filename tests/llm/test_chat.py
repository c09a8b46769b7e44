"""Formatted conversations against a plain reading of the template, and back."""

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, all string, mask int, formatted string"
T = C.Template()
CONTROLS = T.controls()


def escape(s):
    """A backslash goes after the first character of what, without its backslashes, is a control string."""
    out, i = "", 0
    while i < len(s):
        j = i + 1
        while j < len(s) and s[j] == "\\":
            j += 1
        out += s[i]
        if s[i] in "[<" and any(s.startswith(c[1:], j) for c in CONTROLS):
            out += "\\"
        i += 1
    return out


def formatted(turns):
    out = T.begin
    for role, block in groupby(turns, key=lambda t: t[0]):
        first, more, last = T.roles.get(role, T.other)
        for j, (_, text) in enumerate(block):
            out += (more if j else first) + ("" if role in T.roles else escape(role) + T.named) + escape(text)
        out += last
    return out


def random_rows(seed=5, n=120):
    r = random.Random(seed)
    bits = [*CONTROLS, *(c[0] + "\\" + c[1:] for c in CONTROLS), *(c[0] + "\\\\" + c[1:] for c in CONTROLS), "[", "<", "\\", "]", "INST]", "/s>", "\n", " ", "word", "日本", "🙂", "$1", "%"]
    text = lambda: r.choice([None, "", "".join(r.choices(bits, k=r.randint(1, 12)))])
    rows = [(r.randrange(12), r.choice([None, *range(6)]), r.choice([None, "", "user", "assistant", "system", "tool", "a[IS]b", "[ROLE]"]), text(), "x", 1, "y") for _ in range(n)]
    return [*rows, *rows[:10], (50, 0, "assistant", "word " * 60_000 + "</s>", None, None, None), (None, 0, "user", "no id", None, None, None), (51, 0, "system", "only", None, None, None)]


def conversations(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        out.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in out.items()}


def test_formats_and_reads_back(spark):
    rows = random_rows()
    df = C.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: r for r in df.select("*", C.read_turns(F.col("formatted")).alias("back"), C.learned_text(F.col("formatted"), F.col("mask")).alias("learned")).collect()}
    want = conversations(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        g = got[c]
        assert g.formatted == formatted(turns) and [tuple(t) for t in g.back] == turns
        assert g.n_blocks == len(list(groupby(turns, key=lambda t: t[0]))) and g.learned == "".join(t for role, t in turns if role == "assistant")
        at, masked = 0, ""
        for m in g["mask"]:
            masked += g.formatted[at + m.skip : at + m.skip + m.chars] if m.loss else ""
            at += m.skip + m.chars
        assert at == len(g.formatted) and masked == "".join(escape(t) for role, t in turns if role == "assistant")


def test_digests_and_empty_table(spark):
    rows = random_rows(6)
    got = {r.conv_id: r for r in C.digests(C.format_turns(spark.createDataFrame(rows, SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in conversations(rows).items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(said), sha(said), len(formatted(turns)))
    assert C.digests(C.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_mask_of_another_text_is_an_error(spark):
    df = C.format_turns(spark.createDataFrame([(1, 0, "assistant", "yes"), (2, 0, "assistant", "no")], "conv_id long, turn long, role string, text string"))
    other = df.select("conv_id", F.lead("formatted").over(Window.orderBy("conv_id")).alias("formatted"), "mask").where("conv_id = 1")
    with pytest.raises(Exception, match="fit"):
        other.select(C.learned_text(F.col("formatted"), F.col("mask"))).collect()


def test_templates_of_ones_own(spark):
    own = C.Template(begin="<|begin|>", roles={"user": ("<|user|>", "<|user+|>", "<|/user|>"), "bot": ("<|bot|>", "<|bot+|>", "<|end|>")}, other=("<|role|>", "<|role+|>", "<|/role|>"), named="<|is|>", learned=("bot",))
    df = spark.createDataFrame([(1, 0, "user", "hi <|end|>"), (1, 1, "bot", "<|end|>"), (1, 2, "bot", "[INST]"), (1, 3, "assistant", "x")], "conv_id long, turn long, role string, text string")
    f = C.format_turns(df, template=own)
    (row,) = f.select("formatted", C.read_turns(F.col("formatted"), own).alias("t"), C.learned_text(F.col("formatted"), F.col("mask"), own).alias("l")).collect()
    assert row.formatted == "<|begin|><|user|>hi <\\|end|><|/user|><|bot|><\\|end|><|bot+|>[INST]<|end|><|role|>assistant<|is|>x<|/role|>"
    assert [tuple(t) for t in row.t] == [("user", "hi <|end|>"), ("bot", "<|end|>"), ("bot", "[INST]"), ("assistant", "x")] and row.l == "<|end|>[INST]"
    for bad in ({"begin": "s"}, {"begin": "<s>>"}, {"named": "[ROLE]"}):
        with pytest.raises(ValueError):
            C.Template(**bad)
