"""Routing with the verify step, and extraction in stages, with models in the slots."""

from memloom.operators import models, stores


def model(name, sure):
    def make():
        def run(text):
            if "nothing" in text:
                return {"entities": [], "relations": []}
            names = [w for w in text.split() if w[0].isupper()]
            return {"entities": [{"name": n, "type": name, "confidence": sure} for n in names], "relations": [{"source": names[0], "relation": "knows", "target": names[-1], "confidence": sure}] if len(names) > 1 else []}

        return run

    return make


def test_small_answers_are_verified(spark):
    rows = [(1, "Ann met Bob"), (2, "nothing here"), (3, "Ann 因为 Bob"), (4, "Ann " * 40), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.backend, {e.type for e in r.entities}) for r in models.routed(df, "text", model("small", 0.9), model("large", 0.9)).collect()}
    assert got == {1: ("small", {"small"}), 2: ("small+large", set()), 3: ("large", {"large"}), 4: ("large", {"large"}), 5: ("large", set()), 6: ("small+large", set())}
    unsure = {r.id: r.backend for r in models.routed(df, "text", model("small", 0.5), model("large", 0.9)).collect()}
    assert unsure[1] == "small+large"
    plain = {r.id: r.backend for r in models.routed(df, "text", model("small", 0.5), model("large", 0.9), verify=False).collect()}
    assert plain[1] == "small" and plain[3] == "large"


def test_three_stages(spark):
    df = spark.createDataFrame([(1, "Ann met Robert"), (2, "Bob met Bobby"), (3, "nothing here"), (4, None)], "id long, text string")
    aliases = spark.createDataFrame([("bob", "Robert"), ("Bobby", "Robert")], "alias string, canonical string")
    known = spark.createDataFrame([("robert",)], "name string")
    e, r, n = models.in_stages(df, "id", "text", aliases, known, model("person", 0.95))
    assert sorted((x.id, x.name, x.canonical, x.is_existing) for x in e.collect()) == [(1, "Ann", "Ann", False), (1, "Robert", "Robert", True), (2, "Bob", "Robert", True), (2, "Bobby", "Robert", True)]
    assert [(x.id, x.source, x.target) for x in r.collect()] == [(1, "Ann", "Robert")]  # Bob and Bobby are one
    assert sorted(map(tuple, n.collect())) == [(1, 2, 1, 1), (2, 2, 0, 0)]


def test_lookup_over_agents(spark):
    rows = [("x", "a", '[{"turn": 0, "role": "user", "content": "hi"}]'), ("y", "b", "broken ["), ("z", "b", None)]
    df = spark.createDataFrame(rows, "id string, agent string, raw_conversation string")
    assert [(r.agent, [m.content for m in r.messages]) for r in stores.found(df, "id", "x").collect()] == [("a", ["hi"])]
    assert [r.messages for k in "yz" for r in stores.found(df, "id", k).collect()] == [None, None] and stores.found(df, "id", "absent").count() == 0
