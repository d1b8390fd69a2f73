from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerseek.functions.predicates import Fields, compile_predicate
from ledgerseek.functions.text import first_chunks, trim_zeros
from ledgerseek.plans.sqe import And, Group, Literal, Not, Or, Term, fold, parse

ROWS = [
    (i, s, tags, flag, m, b)
    for i, (s, tags, flag, m, b) in enumerate(
        (s, tags, flag, m, b)
        for s in (None, "x", "true") for tags in (None, [], ["x", "y"], ["true"]) for flag in (None, True, False) for m in (None, {"m": ["x", "z"]}) for b in (None, {"m": [True]})
    )
]
WHERE = Fields({"s": "s"}, {"t": "tags"}, {"f": "flag"}, "m", "b")


def holds(expr, row):
    _, s, tags, flag, m, b = row
    text = {"s": [s], "t": tags, "m": (m or {}).get("m"), "f": None, "q": (m or {}).get("q")}
    flags = {"f": [flag], "m": (b or {}).get("m")}

    def one(node, kids):
        if isinstance(node, Term):
            return any(v.boolean in (flags.get(node.field) or ()) if v.boolean is not None else v.value in (text.get(node.field) or ()) for v in node.values)
        return {And: all, Or: any, Not: lambda k: not k[0], Group: lambda k: k[0]}[type(node)](kids)

    return fold(expr, one)


literal = st.builds(Literal, st.sampled_from(["x", "y", "z", "true", "false"]), st.sampled_from(["", '"']))
term = st.builds(Term, st.sampled_from(["s", "t", "f", "m", "q"]), st.lists(literal, max_size=3).map(tuple), st.just(True))
trees = st.recursive(term, lambda c: st.one_of(*(st.builds(k, st.lists(c, min_size=2, max_size=3).map(tuple)) for k in (And, Or)), *(st.builds(k, c.map(lambda x: (x,))) for k in (Not, Group))), max_leaves=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=8, max_size=8))
def test_same_as_evaluator(spark, exprs):
    df = spark.createDataFrame(ROWS, "i int, s string, tags array<string>, flag boolean, m map<string,array<string>>, b map<string,array<boolean>>")
    got = df.select("i", *(compile_predicate(e, WHERE).alias(f"p{k}") for k, e in enumerate(exprs))).collect()
    for r in got:
        assert [r[f"p{k}"] for k in range(len(exprs))] == [holds(e, ROWS[r["i"]]) for e in exprs]


def test_wide(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    assert df.where(compile_predicate(parse(" OR ".join(f"s:{i}" for i in range(2500))), WHERE)).count() == 2500
    values = ", ".join(map(str, range(20_000)))
    assert df.where(compile_predicate(parse(f"-s:[{values}]"), WHERE)).count() == 0


def test_text(spark):
    rows = spark.createDataFrame([("000",), ("0012",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(trim_zeros(F.col("v"))).collect()] == ["0", "12", "", None]
    assert tuple(rows.select(*first_chunks(F.lit("abcde"), 2, 3)).first()) == ("ab", "cd", "e", None)
