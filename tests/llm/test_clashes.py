"""Tables whose other columns have the names that operators use inside."""

from pyspark.sql import functions as F

from loomline.llm.exact_dedup import keep_first
from loomline.llm.mixing import mixed_rows
from loomline.llm.near_dedup import keep_one

NAMES = ["__n", "__size", "__id", "__own", "__part", "n", "own", "row", "plan_id", "plan_size", "plan_n", "part", "cut", "epochs", "kept_id", "taken", "target", "source_size", "group_size", "keep_id", "component_id", "doc", "bucket", "sig"]


def test_other_columns_come_back_as_they_were(docs):
    own = docs.withColumns({name: F.concat(F.lit(name), F.coalesce("text", F.lit("-"))) if i % 2 else F.struct(F.lit(i).alias("id"), "lang") for i, name in enumerate(NAMES)})
    for f in (keep_first, mixed_rows, lambda d: keep_one(d, words=2)):
        got, plain = f(own), f(docs)
        assert got.columns == own.columns and got.count() == plain.count()
        assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))
        for r in got.collect():
            assert all((r[name] == name + (r.text if r.text is not None else "-") or f is mixed_rows) if i % 2 else r[name] == (i, r.lang) for i, name in enumerate(NAMES))
