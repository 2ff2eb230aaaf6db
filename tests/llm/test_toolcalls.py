import json
import random

from seriesmill.llm import toolcalls as tc


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")


def calls(*c):
    return json.dumps({"tool_calls": list(c)})


ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", calls({"id": "b", "name": "add", "arguments": {"b": 1, "a": "$a"}}, {"id": "a", "name": "search", "arguments": {"q": "x", "limit": 2}})),
    (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [1.50, None, "é"]}})),
    (1, 3, "tool", json.dumps({"tool_results": [{"call_id": "a", "content": "ok"}, {"call_id": "a", "content": "again"}, {"call_id": "q", "content": 1}]})),
    (2, 0, "assistant", calls({"id": "x", "name": "nope", "arguments": [], "after": ["y"]}, {"id": "y", "name": "search", "arguments": {"limit": "2", "k": 1}, "after": ["x"]})),
    (2, 1, "tool", "{bad"),
    (3, 0, "assistant", calls({"id": "p", "name": "add", "arguments": {"a": 1, "b": 2.5}}, {"id": "p", "name": "add", "arguments": {}}, {"name": "add"})),
    (None, None, None, None),
    (4, 0, "assistant", '{"tool_calls":"no"}'),
]


def by_key(df):
    return {(r.conv_id, r.turn, r.nth): r for r in df.collect()}


def test_links_levels_and_problems(spark):
    got = by_key(tc.linked(frame(spark, ROWS)))
    assert len(got) == 15
    assert (got[1, 1, 1].status, got[1, 1, 1].level) == ("linked", 0)
    assert (got[1, 1, 0].status, got[1, 1, 0].level, got[1, 1, 0].problems) == ("linked", 1, [])
    assert [got[1, 3, k].status for k in range(3)] == ["linked", "duplicate", "orphan"]
    assert {got[2, 0, k].status for k in range(2)} == {"cycle"}
    assert got[2, 0, 0].problems == ["nope: unknown tool"]
    assert got[2, 0, 1].problems == ["q: missing", "limit: no integer", "k: unknown"]
    assert [got[3, 0, k].status for k in range(3)] == ["unanswered", "duplicate", "unidentified"]
    assert got[3, 0, 1].problems == ["a: missing", "b: missing"]
    assert got[None, None, 0].kind == "message"


def test_order_is_topological(spark):
    rows = tc.linked(frame(spark, ROWS)).where("conv_id = 1").orderBy("sort_turn", "sort_level", "call_id", "kind", "turn", "nth").collect()
    linked = [(r.kind, r.call_id) for r in rows if r.status == "linked"]
    assert linked == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]


def test_json_is_canonical(spark):
    for r in tc.linked(frame(spark, ROWS)).collect():
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if r.kind == "call":
            assert json.loads(r.json)["id" if "id" in json.loads(r.json) else "name"]


def test_long_chain_hot_call_and_empty(spark):
    chain = [(1, k, "assistant", calls({"id": "c%d" % k, "name": "add", "arguments": {"a": 1, "b": 2}, "after": ["c%d" % (k - 1)] if k else []})) for k in range(12)]
    assert {r.turn: r.level for r in tc.linked(frame(spark, chain)).collect()} == {k: k for k in range(12)}
    hot = [chain[0]] * 300
    assert sorted(r.status for r in tc.linked(frame(spark, hot)).collect()) == ["unanswered"] * 300
    assert tc.linked(frame(spark, [])).count() == 0


def brute(rows):
    """(conv_id, turn, nth) -> (status, level) of calls and results, by walking each conversation."""
    out, convs = {}, {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, role, json.loads(text)))
    for c, messages in convs.items():
        messages.sort(key=lambda m: m[0])
        first, after, answers = {}, {}, {}
        for t, role, m in messages:
            for k, x in enumerate(m.get("tool_calls", [])):
                first.setdefault(x["id"], (t, k))
                after.setdefault(x["id"], set()).update(x.get("after", []), (v[1:] for v in x["arguments"].values() if isinstance(v, str) and v.startswith("$")))
            for k, x in enumerate(m.get("tool_results", [])):
                answers.setdefault(x["call_id"], (t, k))
        level, old = {}, None
        while level != old:
            old = dict(level)
            for i, n in after.items():
                if all(x in level for x in n if x in first):
                    level.setdefault(i, 1 + max([level[x] for x in n if x in first], default=-1))
        for t, role, m in messages:
            for k, x in enumerate(m.get("tool_calls", [])):
                i = x["id"]
                status = "duplicate" if first[i] != (t, k) else "cycle" if i not in level else "unanswered" if answers.get(i, (-1, 0)) < first[i] else "linked"
                out[c, t, k] = status, level.get(i)
            for k, x in enumerate(m.get("tool_results", [])):
                i = x["call_id"]
                status = "orphan" if i not in first or (t, k) < first[i] else "duplicate" if answers[i] != (t, k) else "cycle" if i not in level else "linked"
                out[c, t, k] = status, level.get(i)
    return out


def test_against_brute_force_on_generated_conversations(spark):
    rng, rows = random.Random(3), []
    for c in range(40):
        ids = ["c%d" % k for k in range(rng.randint(1, 9))]
        for t in range(rng.randint(1, 8)):
            if rng.random() < 0.6:
                made = [{"id": rng.choice(ids), "name": "add", "arguments": {"a": rng.choice([1, "$" + rng.choice(ids), "$none"]), "b": 2}, "after": rng.sample(ids, rng.randint(0, min(1, len(ids))))} for _ in range(rng.randint(1, 3))]
                rows.append((c, t, "assistant", json.dumps({"tool_calls": made})))
            else:
                rows.append((c, t, "tool", json.dumps({"tool_results": [{"call_id": rng.choice(ids), "content": "z" * 10} for _ in range(rng.randint(1, 3))]})))
    got = {k: (r.status, r.level) for k, r in by_key(tc.linked(frame(spark, rows))).items() if r.kind != "message"}
    assert got == brute(rows) and len({s for s, _ in got.values()}) == 5


def test_forms_and_references(spark):
    rows = [
        (1, 0, "assistant", json.dumps({"content": "I look it up", "tool_calls": [{"id": "f", "type": "function", "function": {"name": "search", "arguments": json.dumps({"q": "x"})}}, {"id": "b", "name": "add", "arguments": {"$b": 1, "a": "$5", "b": "$f"}, "note": "kept"}]})),
        (2, 0, "user", "long " * 200_000),
        (2, 1, "assistant", calls({"id": "long", "name": "search", "arguments": {"q": "y" * 500_000}})),
    ]
    got = by_key(tc.linked(frame(spark, rows)))
    assert (got[1, 0, 0].status, got[1, 0, 0].problems) == ("unanswered", [])
    assert (got[1, 0, 1].status, got[1, 0, 1].level, got[1, 0, 1].problems) == ("unanswered", 1, ["a: no number", "$b: unknown"])
    assert json.loads(got[1, 0, 1].json)["note"] == "kept" and got[1, 0, 2].kind == "message" and json.loads(got[1, 0, 2].json) == {"role": "assistant", "content": "I look it up"}
    assert len(got[2, 0, 0].json) > 1_000_000 and got[2, 1, 0].problems == []


def test_main_path_has_no_python(spark):
    plan = tc.linked(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
