import hashlib
import json
import random
import re

import numpy as np
import pytest

from nestwell.llm import chat, decontaminate, quality


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def contaminated(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            n = min(window, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == iw[k : k + n]:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("window", [4, 10])
def test_decontamination_equals_brute_force(spark, frame, oddities, prose, window, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 40)
    rnd = random.Random(8)
    items = [(i, prose(rnd.randint(12, 25), 500 + i)) for i in range(12)] + [(20, "Only three words"), (21, "single"), (22, ""), (23, None), (24, "...")] + [(3, prose(14, 503))]
    docs = [(i, t) for i, t in oddities if not t or len(t) < 5000]
    for i in range(60):
        t = prose(30, 100 + i).split()
        item = words(rnd.choice(items)[1] or "x")
        k = rnd.randint(0, max(0, len(item) - 3))
        t[10:10] = item[k : k + rnd.randint(2, 14)] * rnd.randint(1, 2)
        docs.append((1000 + i, rnd.choice([" ", ", ", "-"]).join(t).title() if i % 5 == 0 else " ".join(t)))
    docs += [(2000, "!single?"), (2001, "singles"), (2002, "  only THREE words only three words  "), (2003, "\x7fonly\x00three words")]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, w string")
    got = decontaminate.report(decontaminate.decontaminate(frame(docs), table, window)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == contaminated(docs, items, window)


def test_decontamination_edges(spark, frame):
    none = spark.createDataFrame([], "item_id int, text string")
    got = decontaminate.decontaminate(frame([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in got) == [(1, 2, False), (2, 0, False)]
    some = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    assert decontaminate.decontaminate(frame([]), some).count() == 0
    kept = decontaminate.drop_contaminated(frame([(1, "x a b c"), (2, "a b"), (None, "q")]), some)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
    plan = decontaminate.decontaminate(frame([(1, "a b c")]), some)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_without_an_id_contaminate(spark, frame):
    items = spark.createDataFrame([(None, "a b c"), (None, "solo"), (7, "b c d")], "item_id int, text string")
    docs = frame([(1, "x a b c y"), (2, "a b c d"), (3, "solo"), (4, "x y")])
    got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (3, 0, [], True), 2: (4, 1, ["7"], True), 3: (1, 0, [], True), 4: (0, 0, [], False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [4]


def test_label_model_finds_accuracies():
    rnd = np.random.default_rng(5)
    truth = rnd.random(20_000) < 0.85
    right = [0.95, 0.9, 0.8, 0.75, 0.7]
    votes = np.stack([np.where(rnd.random(len(truth)) < 0.2, -1, np.where(rnd.random(len(truth)) < r, truth, ~truth)) for r in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit_labellers(patterns, counts.astype(float))
    assert np.abs(m["accuracy"] - right).max() < 0.05 and abs(m["prior"] - 0.85) < 0.03


def junk(rnd, prose, seed):
    t = prose(80, seed).split()
    return rnd.choice([" ".join(w + rnd.choice(["###", "&&&", "%%%"]) for w in t), " ".join(w.upper() + "!!" for w in t), " ".join(w for w in t for _ in range(9)), " | ".join(t)])


def test_classifier_on_held_out_rows(frame, prose):
    rnd = random.Random(2)
    text = lambda i: ". ".join(prose(12, 100 * i + k).capitalize() for k in range(8)) + "."
    rows = [(i, text(i) if i % 6 else junk(rnd, prose, i)) for i in range(600)]
    got = {r.doc_id: r for r in quality.classify(frame(rows)).collect()}
    assert np.mean([got[i].accepted == (i % 6 != 0) for i, _ in rows]) > 0.97
    model = quality.train(frame(rows))
    fresh = [(1000 + i, text(1000 + i) if i % 6 else junk(rnd, prose, 5000 + i)) for i in range(300)]
    got = {r.doc_id: r.accepted for r in quality.score(frame(fresh), model).collect()}
    assert np.mean([got[1000 + i] == (i % 6 != 0) for i in range(300)]) > 0.97


def test_classifier_on_the_labelled_documents(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"))
    both = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "truth").join(got, "doc_id").collect()
    good = [r for r in both if r.truth == 1]
    assert np.mean([r.accepted for r in good]) > 0.99 and np.mean([r.accepted == bool(r.truth) for r in both]) > 0.97


def test_classifier_edges(frame, oddities):
    got = quality.classify(frame(oddities)).collect()
    assert len(got) == len(oddities) and all(not r.accepted and r.quality == 0 for r in got if r.doc_id in (1, 2, 3))
    same = {(r.quality, r.n_words) for r in got if r.doc_id in (5, 6)}
    assert len(same) == 1 and quality.classify(frame([])).count() == 0
    kept = quality.drop_rejected(frame(oddities))
    assert kept.columns == frame(oddities).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.accepted)
    assert quality.drop_rejected(frame([])).count() == 0


def test_shapes_hold_whole_words_of_all_scripts():
    shape = lambda w: quality._word(w)[0]
    assert shape("a1" * 32 + "-X") != shape("a1" * 32 + "+x") and shape("日本語" * 40 + "。") == shape("中" * 500 + "。") != shape("中" * 500)
    assert shape("слово,") == shape("другое,") == shape("word,") and shape("СловоДва") == shape("WordTwo") and shape("λόγος;") == shape("ab;") and shape("٣٤x") == shape("34x")
    bare = list(quality.LABELLERS).index("bare_marks")
    assert quality.measure("-" * 64 + "word " + "ok")[1][bare] == 0 and quality.measure("-" * 64 + " ok")[1][bare] == 0.5
    rnd = random.Random(3)
    for _ in range(300):
        w = "".join(rnd.choice("aZé9-.ЖжΣσ٣中ǅ😀") for _ in range(rnd.randint(1, 150)))
        fold = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isalnum() else c for c in w)
        assert shape(w) == quality._feature(re.sub(r"(.)\1+", r"\1", fold))


J = json.dumps
TURNS = [
    (1, 0, "user", 'hi é "q"'),
    (1, 1, "assistant", J({"content": "calling", "tool_calls": [{"id": "b", "name": "search", "arguments": {"query": "x", "limit": 2}, "after": ["a"]}, {"id": "a", "function": {"name": "calculate", "arguments": '{"expression": "1+1"}'}}, {"id": "c", "name": "nope", "arguments": {}}, {"id": "d", "name": "fetch", "arguments": {"url": 3, "z": 1}}, {"name": "search", "arguments": "bad"}]})),
    (1, 2, "tool", J({"tool_call_id": "a", "content": {"z": 1, "a": [1.50, True, None]}})),
    (1, 3, "tool", J({"tool_call_id": "a", "content": "again"})),
    (1, 4, "tool", J({"tool_call_id": "zz", "content": "x"})),
    (1, 5, None, None),
    (2, 0, "assistant", "{broken"),
    (3, 0, "assistant", J({"tool_calls": [{"id": "p", "name": "search", "arguments": {"query": "q"}, "after": ["q"]}, {"id": "q", "name": "search", "arguments": {"query": "q"}, "after": ["p"]}]})),
    (None, 1, "user", "x"),
    (4, 0, "tool", J({"tool_call_id": "e", "content": 1})),
    (4, 1, "assistant", J({"tool_calls": [{"id": "e", "name": "search", "arguments": {}}, {"id": "e", "name": "search", "arguments": {"query": "q"}}]})),
]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, status string, part int")


def test_tool_calls(spark):
    got = chat.format_chat(turns(spark, TURNS)).collect()
    calls = {(r.conv_id, r.turn, r.part): (r.call_id, r.level, r.status, r.errors, r.json) for r in got if r.kind == "call"}
    assert calls[1, 1, 0] == ("b", 1, "no_result", "", '{"arguments":{"limit":2,"query":"x"},"id":"b","name":"search"}')
    assert calls[1, 1, 1] == ("a", 0, "linked", "", '{"arguments":{"expression":"1+1"},"id":"a","name":"calculate","result":{"a":[1.5,true,null],"z":1}}')
    assert calls[1, 1, 2][2:4] == ("no_result", "unknown_tool") and calls[1, 1, 3][3] == "type:url,unknown:z" and calls[1, 1, 4][2:4] == ("no_id", "no_object")
    assert calls[3, 0, 0][1] is None and calls[3, 0, 1][1] is None, "a cycle has no order"
    assert calls[4, 1, 0][2:4] == ("no_result", "missing:query") and calls[4, 1, 1][2] == "repeated"
    assert {(r.conv_id, r.turn): r.status for r in got if r.kind == "result"} == {(1, 2): "linked", (1, 3): "repeated", (1, 4): "no_call", (4, 0): "early"}
    plain = {(r.conv_id, r.turn): r.json for r in got if r.kind == "message"}
    assert plain[1, 0] == '{"content":"hi é \\"q\\"","role":"user"}' and plain[1, 5] == '{"content":"","role":"unknown"}' and plain[2, 0] == '{"content":"{broken","role":"assistant"}' and (None, 1) in plain
    assert chat.format_chat(turns(spark, [])).count() == 0
    plan = chat.format_chat(turns(spark, TURNS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_calls_equal_brute_force(spark):
    """Random conversations: links by first identifier, levels by longest wait."""
    rnd = random.Random(6)
    rows, want = [], {}
    for conv in range(30):
        first, results, turn = {}, {}, 0
        for _ in range(rnd.randint(1, 6)):
            ids = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 3))]
            after = [[rnd.choice("abcdefgh")] if rnd.random() < 0.4 else [] for _ in ids]
            rows.append((conv, turn, "assistant", J({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": "q"}, "after": a} for i, a in zip(ids, after, strict=True)]})))
            for k, (i, a) in enumerate(zip(ids, after, strict=True)):
                want[conv, turn, k] = [i, a, "repeated" if i in first else None]
                first.setdefault(i, (turn, k))
            turn += 1
            if rnd.random() < 0.7:
                i = rnd.choice("abcdefgh")
                results.setdefault(i, turn)
                rows.append((conv, turn, "tool", J({"tool_call_id": i, "content": "r"})))
                turn += 1
        waits: dict = {}
        for (c, t, k), (i, a, _) in want.items():
            if c == conv:
                waits.setdefault(i, set()).update(x for x in a if x in first)
        level: dict = {}
        while True:
            ready = [i for i in waits if i not in level and waits[i] <= set(level)]
            if not ready:
                break
            level |= {i: max((level[x] + 1 for x in waits[i]), default=0) for i in ready}
        for key, v in want.items():
            if key[0] == conv:
                v[2] = v[2] or ("linked" if v[0] in results and results[v[0]] >= key[1] else "no_result")
                v[1] = level.get(v[0])
    got = {(r.conv_id, r.turn, r.part): [r.call_id, r.level, r.status] for r in chat.format_chat(turns(spark, rows)).collect() if r.kind == "call"}
    assert got == want


def test_each_call_gets_its_own_result(spark, monkeypatch):
    """Random conversations whose identifiers are used again: each result belongs to the latest call before it."""
    monkeypatch.setattr(chat, "TURN_BITS", 1)
    rnd = random.Random(9)
    call = lambda *ids: ("assistant", J({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": "q"}} for i in ids]}))
    answer = lambda i, c: ("tool", J({"tool_call_id": i, "content": c}))
    rows = [(-1, 3, *answer("a", "stray")), (-1, 5, *call("a")), (-1, 6, *answer("a", "real")), (-1, 7, *call("a")), (-1, 8, *answer("a", "second")), (-1, 9, *answer("a", "late"))]
    for conv in range(25):
        for turn in range(rnd.randint(2, 14)):
            rows.append((conv, turn, *(call(*[rnd.choice("abc") for _ in range(rnd.randint(1, 2))]) if rnd.random() < 0.5 else answer(rnd.choice("abcd"), f"r{turn}"))))
    want, latest, seen = {}, {}, set()
    for conv, turn, role, text in rows:
        if role == "assistant":
            for k, c in enumerate(json.loads(text)["tool_calls"]):
                want[conv, turn, k, "call"] = ["repeated" if (conv, c["id"]) in seen else "no_result", None]
                seen.add((conv, c["id"]))
                latest[conv, c["id"]] = (conv, turn, k, "call")
            continue
        i, mine = json.loads(text)["tool_call_id"], latest.get((conv, json.loads(text)["tool_call_id"]))
        known = any((c, i) == (conv, x["id"]) for c, _, r, t in rows if r == "assistant" for x in json.loads(t)["tool_calls"])
        state = "no_call" if not known else "early" if mine is None else "repeated" if want[mine][0] == "linked" else "linked"
        if state == "linked":
            want[mine] = ["linked", json.loads(text)["content"]]
        want[conv, turn, 0, "result"] = [state, None]
    found = chat.format_chat(turns(spark, rows), per_call=True).filter("kind <> 'message'").collect()
    got = {(r.conv_id, r.turn, r.part, r.kind): [r.status, json.loads(r.json).get("result")] for r in found}
    assert len(found) == len(want) and got == want
    assert got[-1, 5, 0, "call"] == ["linked", "real"] and got[-1, 7, 0, "call"] == ["linked", "second"] and got[-1, 3, 0, "result"] == ["early", None]
    assert chat.format_chat(turns(spark, []), per_call=True).count() == 0
    # no turn, no conversation and equal rows
    odd = [(1, None, *call("a")), (1, None, *answer("a", "x")), (None, 1, *call("a")), (2, 1, *call("b")), (2, 1, *call("b")), (2, 2, *answer("b", "y")), (2, 2, *answer("b", "y"))]
    states = sorted((str(r.conv_id), r.kind, r.status) for r in chat.format_chat(turns(spark, odd), per_call=True).filter("kind <> 'message'").collect())
    assert states == [("1", "call", "linked"), ("1", "result", "linked"), *[("2", "call", "linked")] * 2, *[("2", "result", "linked")] * 2, ("None", "call", "no_id")]
