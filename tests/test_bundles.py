"""Bundles against a plain priority queue and a plain greedy fill."""

import heapq
import random

from cairn.operators import bundles


def queue(seeds, deps, sim, tokens, budget, least):
    heap, seen, out, spent = [(-sim[s], s) for s in set(seeds) if s in sim], set(), [], 0
    heapq.heapify(heap)
    while heap and spent < budget:
        neg, node = heapq.heappop(heap)
        if node in seen:
            continue
        seen.add(node)
        if spent + tokens[node] > budget:
            continue
        spent += tokens[node]
        out.append((node, len(out) + 1, spent))
        for d in deps.get(node, ()):
            if d in sim and d not in seen and sim[d] > least:
                heapq.heappush(heap, (-sim[d], d))
    return out


def test_best_first_like_a_queue(spark, monkeypatch):
    rnd = random.Random(4)
    ids = [f"s{k:02}" for k in range(60)]
    vectors = {i: [rnd.choice((-0.8, 0.1, 0.6, 0.9)), rnd.choice((0.0, 0.5))] for i in ids}
    tokens = {i: rnd.randint(1, 30) for i in ids}
    deps = {i: rnd.sample([*ids, "gone"], rnd.randint(0, 6)) for i in ids}
    asked = {q: ([1.0, rnd.random()], rnd.sample([*ids, "gone"], rnd.randint(0, 5))) for q in range(12)}
    symbols = spark.createDataFrame([(i, vectors[i], tokens[i], f"f{int(i[1:]) % 4}") for i in ids], "id string, vector array<double>, tokens long, file string")
    edges = spark.createDataFrame([(a, b) for a, bs in deps.items() for b in bs], "src string, dst string")
    questions = spark.createDataFrame([(q, v) for q, (v, _) in asked.items()], "question int, vector array<double>")
    seeds = spark.createDataFrame([(q, s) for q, (_, ss) in asked.items() for s in ss], "question int, id string")
    for ahead, budget in ((64, 120), (1, 60)):
        monkeypatch.setattr(bundles, "AHEAD", ahead)
        got = {tuple(r) for r in bundles.best_first(seeds, edges, questions, symbols, budget).collect()}
        sims = {q: {i: round(sum(a * b for a, b in zip(v, vectors[i])), 6) for i in ids} for q, (v, _) in asked.items()}
        assert got == {(q, *t) for q, (_, ss) in asked.items() for t in queue(ss, deps, sims[q], tokens, budget, 0.4)}
    aimed = bundles.best_first(seeds, edges, questions, symbols, 60, targets=spark.createDataFrame([(q, "f1") for q in asked], "question int, file string"))
    assert {r["id"] for r in aimed.collect()} <= {i for i in ids if int(i[1:]) % 4 == 1} | {s for _, ss in asked.values() for s in ss}


def test_best_first_carries_only_open_questions(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(bundles, "AHEAD", 1)
    monkeypatch.setattr(bundles, "stored", lambda df, name: rounds.append(df.cache()) or rounds[-1])
    symbols = spark.createDataFrame([(f"s{k}", [1.0], 10) for k in range(5)], "id string, vector array<double>, tokens long")
    edges = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(4)], "src string, dst string")
    questions = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "question int, vector array<double>")
    got = bundles.best_first(spark.createDataFrame([(1, "gone"), (1, "s4"), (2, "s1")], "question int, id string"), edges, questions, symbols, 20)
    assert {tuple(r) for r in got.collect()} == {(1, "s4", 1, 10), (2, "s1", 1, 10), (2, "s2", 2, 20)}
    held = [{r["question"] for r in df.collect()} for df in rounds if "question" in df.columns]
    assert {1, 2} in held and held[-1] == {2}


def test_two_pass_like_a_greedy_fill(spark):
    rnd = random.Random(5)
    ranked = [(q, f"s{k}", r + 1) for q in range(8) for r, k in enumerate(rnd.sample(range(30), 12))]
    deps = [(f"s{a}", f"s{b}") for a in range(30) for b in rnd.sample(range(30), 3)]
    sizes = {f"s{k}": [rnd.randint(10, 200), rnd.randint(4, 9), 2][: rnd.randint(1, 3)] for k in range(28)}
    want = set()
    for q in range(8):
        own = [i for _, i, _ in sorted((r for r in ranked if r[0] == q), key=lambda r: r[2])]
        order = own[:2] + [d for t in own[:2] for d in sorted(b for a, b in deps if a == t)] + own[2:]
        spent = 0
        for n, i in enumerate(dict.fromkeys(order)):
            s = sizes.get(i)
            if s is None:
                continue
            if i in own[:2]:
                level = 0 if s[0] <= 1.5 * 90 or len(s) == 1 else 1
            else:
                level = next((k for k, t in enumerate(s) if spent + t <= 90), None)
            if level is not None:
                spent += s[level]
                want.add((q, i, level, s[level], spent))
    df = spark.createDataFrame(ranked, "question int, id string, rank int")
    order = bundles.reading_order(df, spark.createDataFrame(deps, "src string, dst string"))
    got = bundles.two_pass(order, spark.createDataFrame(list(sizes.items()), "id string, sizes array<int>"), 90)
    assert {tuple(r) for r in got.collect()} == want
    assert bundles.two_pass(order.limit(0), spark.createDataFrame(list(sizes.items()), "id string, sizes array<int>"), 90).count() == 0
