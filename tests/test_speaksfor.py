"""The closure over long chains and cycles."""

from cloakwork.operators.speaksfor import closure


def test_long_chain_and_cycle(spark):
    edges = [(f"{i}", f"{i + 1}") for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    got = {(r.root, r.uid): r.depth for r in closure(spark.createDataFrame(edges, "old_uid string, new_uid string")).collect()}
    want = {(str(i), str(j)): j - i for i in range(100) for j in range(i, 101)}
    assert got == want | {(a, b): (j - i) % 3 for i, a in enumerate("xyz") for j, b in enumerate("xyz")} | {("s", "s"): 0}


def test_frontier_over_long_chains(spark):
    from cloakwork.operators.speaksfor import nearest_ancestor, pseudoprincipals

    edges = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(20)] + [("x", "y"), ("y", "x"), ("3", "z")], "old_uid string, new_uid string")
    assert {r.uid for r in pseudoprincipals(edges, 2).collect()} == {str(i) for i in range(2, 21)} | {"z"}
    gone = spark.createDataFrame([(f"{i}",) for i in range(6, 21)] + [("x",), ("y",)], "uid string")
    assert {(r.uid, r.ancestor) for r in nearest_ancestor(edges, gone).collect()} == {(str(i), "5") for i in range(6, 21)}
