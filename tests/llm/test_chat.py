import json
import random
from collections import defaultdict

import pytest

from rankweave.llm.chat import format_chats

TOOLS = json.dumps({"tools": [{"name": "f", "parameters": {"properties": {"x": {"type": "integer"}, "s": {"type": "string"}}, "required": ["x"]}}]})
call = lambda i, arguments, name="f": {"id": i, "name": name, "arguments": arguments}


def chats(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, part string")
    return {(r["conv_id"], r["part"]): r for r in format_chats(df, **kw).collect()}


def test_results_follow_their_calls_and_arguments_are_checked(spark):
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "user", 'hi "é"'),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "early"})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c1", {"x": 1, "s": "a"}), call("c2", {"s": 3, "z": {"b": 1, "a": 2}})]})),
        (1, 4, "assistant", json.dumps({"content": "k", "tool_calls": [call("c3", json.dumps({"x": {"$ref": "c2"}})), call("c4", {}, "nope")]})),
        (1, 5, "tool", json.dumps({"content": {"v": 2, "a": [1]}, "tool_call_id": "c2"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "zzz", "content": "orphan"})),
    ]
    row = chats(spark, rows)[1, 0]
    assert (row["n_messages"], row["n_calls"], row["n_invalid"], row["n_results"], row["n_unlinked"]) == (7, 4, 2, 3, 1)
    messages = json.loads(row["chat"])
    # canonical: keys sorted, no white space
    assert row["chat"] == json.dumps(messages, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    order = [m.get("tool_call_id") or (m.get("tool_calls") or [{}])[0].get("id") for m in messages]
    assert order[2:] == ["c1", "c1", "c2", "c3", "zzz"]
    assert [c["errors"] for m in messages for c in m.get("tool_calls", [])] == [[], ["missing x", "type of s", "undeclared z"], [], ["no schema"]]
    assert messages[4]["content"] == {"a": [1], "v": 2}


def test_cycles_keep_their_turns(spark):
    rows = [
        (3, 0, "assistant", json.dumps({"tool_calls": [call("a", {"x": {"$ref": "b"}})]})), (3, 1, "tool", json.dumps({"tool_call_id": "a", "content": "1"})),
        (3, 2, "assistant", json.dumps({"tool_calls": [call("b", {"x": {"$ref": "a"}})]})), (3, 3, "tool", json.dumps({"tool_call_id": "b", "content": "1"})),
    ]
    messages = json.loads(chats(spark, rows)[3, 0]["chat"])
    assert [m["role"] for m in messages] == ["assistant", "tool", "assistant", "tool"]


def test_a_deep_chain_and_shared_needs_follow_the_longest_way(spark):
    # every call needs the result of the one with the next number, and all stand in reverse order
    n, rows = 40, []
    for k in range(n):
        refs = {"x": {"$ref": f"c{k + 1}"}} if k < n - 1 else {}
        if k % 5 == 0:
            refs["y"] = {"$ref": f"c{n - 1}"}
        rows += [(5, 2 * k, "assistant", json.dumps({"tool_calls": [call(f"c{k}", refs)]})), (5, 2 * k + 1, "tool", json.dumps({"tool_call_id": f"c{k}", "content": str(k)}))]
    messages = json.loads(chats(spark, rows, part_turns=1000)[5, 0]["chat"])
    order = [(m.get("tool_call_id") or m["tool_calls"][0]["id"], m["role"]) for m in messages]
    assert order == [(f"c{k}", role) for k in reversed(range(n)) for role in ("assistant", "tool")]


def test_nulls_ties_repeats_and_parts(spark):
    rows = [(None, None, None, None), (2, 0, "user", "{broken"), (2, 0, "user", "{broken"), (2, 0, "assistant", ""), (2, 300, "user", "x" * 50_000)]
    found = chats(spark, rows)
    assert json.loads(found[None, None]["chat"]) == [{"content": None, "role": None}]
    assert [m["role"] for m in json.loads(found[2, 0]["chat"])] == ["assistant", "user", "user"]
    assert found[2, 0]["n_messages"] == 3 and found[2, 1]["n_messages"] == 1


def test_empty_table(spark):
    assert chats(spark, []) == {}


def plain_chat(rows):
    """One conversation of (turn, role, text), message by message: {part: (counts, messages)}."""
    body = {r: json.loads(r[2]) if r[2].startswith("{") else {} for r in rows}
    calls = [(r, nth, c) for r in set(rows) if r[1] == "assistant" for nth, c in enumerate(body[r].get("tool_calls", []))]
    results = [r for r in set(rows) if r[1] == "tool" and "tool_call_id" in body[r]]
    schemas, first, answer = {}, {}, {}
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    declared = [(r[0], canonical(t["parameters"]), t) for r in rows if r[1] == "system" for t in body[r].get("tools", [])]
    for _, _, t in sorted(declared, key=lambda x: x[:2], reverse=True):
        schemas[t["name"]] = t["parameters"]
    for r, _, c in sorted(calls, key=lambda x: (x[0][0], x[1], x[0][2]), reverse=True):
        first[c["id"]] = r
    for r in sorted(results, key=lambda r: (r[0], r[2]), reverse=True):
        if body[r]["tool_call_id"] in first:
            answer[body[r]["tool_call_id"]] = r
    needs = defaultdict(set)
    for r in results:
        needs[r] |= {first[i] for i in [body[r]["tool_call_id"]] if i in first}
    for r, _, c in calls:
        needs[r] |= {answer[v["$ref"]] for v in c["arguments"].values() if isinstance(v, dict) and v.get("$ref") in answer}

    def place(r, above=()):
        if r in above:
            raise RecursionError
        return max([(r[0], 0), *((t, d + 1) for t, d in (place(u, (*above, r)) for u in needs[r]))])

    try:
        places = {r: place(r) for r in set(rows)}
    except RecursionError:
        places = {r: (r[0], 0) for r in rows}

    def errors(c):
        if c["name"] not in schemas:
            return ["no schema"]
        wanted, found = schemas[c["name"]], []
        for n, v in c["arguments"].items():
            if n not in wanted["properties"]:
                found.append(f"undeclared {n}")
                continue
            kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict}[wanted["properties"][n]["type"]]
            if not (isinstance(v, dict) and "$ref" in v) and (not isinstance(v, kinds) or (isinstance(v, bool) and kinds is not bool)):
                found.append(f"type of {n}")
        return sorted(found + [f"missing {n}" for n in wanted["required"] if n not in c["arguments"]])

    parts = defaultdict(lambda: ([0, 0, 0, 0, 0], []))
    for r in sorted(rows, key=lambda r: (*places[r], *r)):
        counts, messages = parts[places[r][0] // 4]
        counts[0] += 1
        own = body[r].get("tool_calls") if r[1] == "assistant" else None
        if own:
            made = [{**c, "errors": errors(c)} for c in own]
            counts[1] += len(made)
            counts[2] += sum(bool(c["errors"]) for c in made)
            messages.append({"content": body[r].get("content"), "role": "assistant", "tool_calls": made})
        elif r in results:
            linked = body[r]["tool_call_id"] in first
            counts[3] += 1
            counts[4] += not linked
            messages.append({"content": body[r]["content"], "linked": linked, "role": "tool", "tool_call_id": body[r]["tool_call_id"]})
        else:
            messages.append({"content": r[2], "role": r[1]})
    return parts


@pytest.mark.parametrize("seed", [1, 2])
def test_linking_ordering_and_checks_are_those_of_a_plain_version(spark, seed):
    rng = random.Random(seed)
    values = [1, 10**25, 1.5, "1", True, {"a": 1}, None]
    rows = []
    for conv in range(80):
        ids = [f"c{k}" for k in range(rng.choice([2, 4, 9]))]
        for _ in range(rng.randint(1, 14)):
            turn, kind = rng.randrange(12), rng.random()
            if kind < 0.15:
                properties = {n: {"type": rng.choice(["string", "integer", "number", "boolean", "object"])} for n in rng.sample("xyz", 2)}
                made = "system", {"tools": [{"name": rng.choice("fg"), "parameters": {"properties": properties, "required": rng.sample("xyz", 1)}}]}
            elif kind < 0.55:
                refs = lambda: {n: rng.choice([*values, *({"$ref": i} for i in ids)]) for n in rng.sample("xyzw", rng.randrange(4))}
                made = "assistant", {"tool_calls": [call(rng.choice(ids), refs(), rng.choice("fgh")) for _ in range(rng.randint(1, 2))]} | ({"content": "say"} if rng.random() < 0.5 else {})
            elif kind < 0.9:
                made = "tool", {"tool_call_id": rng.choice([*ids, "none"]), "content": rng.choice(["r", {"b": [1], "a": "\u00e9"}])}
            else:
                made = "user", f"text {rng.randrange(5)}"
            rows += [(conv, turn, made[0], made[1] if made[0] == "user" else json.dumps(made[1]))] * rng.choice([1, 1, 1, 2])
    found = chats(spark, rows, part_turns=4)
    seen = 0
    for conv in range(80):
        for part, (counts, messages) in plain_chat([r[1:] for r in rows if r[0] == conv]).items():
            row = found[conv, part]
            assert [row[c] for c in ("n_messages", "n_calls", "n_invalid", "n_results", "n_unlinked")] == counts
            assert json.loads(row["chat"]) == messages
            seen += 1
    assert seen == len(found)
