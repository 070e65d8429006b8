"""What meets in near dedup is exchanged: the planner cannot see how many rows arrays and sequences make."""

from spanwright.llm import near_copies
from spanwright.llm.near_copies import shingle_hashes


def test_meetings_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEET", 4)
    texts = [f"a b c d e f g h i j k l m n o p q r s t u{n // 2}" for n in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "cls long, text string")
    keyed = spark.createDataFrame([(n, 7) for n in range(60)], "cls long, key long")
    joined, join = [], near_copies._with_sets

    def kept(meeting, sets):
        joined.append(join(meeting, sets))
        return joined[-1]

    monkeypatch.setattr(near_copies, "_with_sets", kept)
    links = near_copies._links(keyed, rows, 5, 0.8)
    for df in joined:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(joined) == 2 and "SortMergeJoin [cls" in plan
    root = {n: n for n in range(60)}
    for a, b in links.collect():
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in range(60) for b in range(60)) and set(root.values()) == {0}
