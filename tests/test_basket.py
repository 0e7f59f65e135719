"""Basket mining against brute force on small hand-made baskets."""

import itertools

from pyspark.sql import functions as F

from shopsight.operators import basket as bk

BASKETS = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"],
           ["d"], ["a", "d"], ["b", "c", "d"], ["a", "b", "c", "d"], ["c"]]


def _tx(spark, tenants=(1, 2)):
    rows = []
    for t in tenants:
        for i, b in enumerate(BASKETS[: 10 if t == 1 else 7]):
            for item in b:
                rows.append((t, f"o{i}", item))
                if item == "a":
                    rows.append((t, f"o{i}", item))     # a product twice in one order
    return spark.createDataFrame(rows, "tenant_id int, order_id string, product_code string")


def _brute(baskets, min_support):
    n = len(baskets)
    sets = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for c in itertools.combinations(sorted(set(b)), k):
                sets[c] = sets.get(c, 0) + 1
    return {c: f for c, f in sets.items() if f / n >= min_support}, n


def test_itemsets_and_rules_match_brute_force(spark):
    b = bk.baskets(_tx(spark))
    got_sets = bk.frequent_itemsets(b, 0.2).collect()
    rules = bk.association_rules(bk.frequent_itemsets(b, 0.2), 0.1).collect()
    for t, n_b in ((1, 10), (2, 7)):
        exp, n = _brute(BASKETS[:n_b], 0.2)
        got = {tuple(r["items"]): r["freq"] for r in got_sets if r["tenant_id"] == t}
        assert got == exp
        exp_rules = {}
        for s, f in exp.items():
            for k in range(1, len(s)):
                for a in itertools.combinations(s, k):
                    c = tuple(x for x in s if x not in a)
                    conf = (f / n) / (exp[a] / n)
                    if conf >= 0.1:
                        exp_rules[(a, c)] = (f / n, conf, conf / (exp[c] / n))
        got_rules = {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["support"], r["confidence"], r["lift"])
                     for r in rules if r["tenant_id"] == t}
        assert set(got_rules) == set(exp_rules)
        for key, v in exp_rules.items():
            assert all(abs(x - y) < 1e-12 for x, y in zip(got_rules[key], v))


def test_size_three_itemset_has_six_splits(spark):
    b = bk.baskets(spark.createDataFrame([(1, "o1", x) for x in "xyz"], "tenant_id int, order_id string, product_code string"))
    r = bk.association_rules(bk.frequent_itemsets(b, 0.5), 0.0).filter(F.size("antecedent") + F.size("consequent") == 3)
    assert r.count() == 6
    for row in r.collect():   # confidence * support(antecedent) = support
        assert abs(row.confidence * row.antecedent_support - row.support) < 1e-12


def test_top_items_ties_and_guard(spark):
    tx = spark.createDataFrame([(1, "o1", "b"), (1, "o2", "a"), (1, "o3", "c"), (1, "o4", "c")],
                               "tenant_id int, order_id string, product_code string")
    top = [(r.product_code, r.rank) for r in bk.top_items(tx, 2).orderBy("rank").collect()]
    assert top == [("c", 1), ("a", 2)]
    assert sorted(r.product_code for r in bk.keep_top_items(tx, 2).collect()) == ["a", "c", "c"]


def test_rules_in_range_and_lift_class(spark):
    r = spark.createDataFrame([(1, 0.01, 0.5, 2.5), (1, 0.2, 0.9, 1.0), (1, 0.05, 0.4, 2.0)],
                              "tenant_id int, support double, confidence double, lift double")
    assert bk.rules_in_range(r, 0.1, 0.0, 0.3, 0.6).count() == 2       # swapped bounds
    assert bk.rules_in_range(r, 0.1, 0.1, 0.3, 0.6).count() == 3       # empty range: no filter
    cls = [x.lift_class for x in bk.classify_lift(r).orderBy("support").collect()]
    assert cls == ["target", "background", "background"]


def test_no_product_is_cut_by_default(spark):
    from shopsight.plans import jobs
    n = 2100
    rows = [(1, f"o{i % 700}", f"p{i}") for i in range(n)]
    tx = spark.createDataFrame(rows, "tenant_id int, order_id string, product_code string")
    assert bk.keep_top_items(tx, None).count() == n
    assert bk.frequent_itemsets(bk.baskets(tx), 0.001).filter("n_items = 1").count() == n
    headers, rules = jobs.run_basket(tx, min_support=0.001, min_confidence=0.9)
    assert headers.count() == 1 and rules.count() == 700 * 12        # every triple: 6 single and 6 double splits


def test_large_itemset_gives_rules(spark):
    """A 21-item set whose confidences are only reached with one item on the right."""
    items = [f"i{k:02d}" for k in range(21)]
    sets = [(1, items, 21, 0.5)] + [(1, [x], 1, 0.5) for x in items]
    sets += [(1, items[:k] + items[k + 1:], 20, 0.6) for k in range(21)]
    sets += [(1, [x for x in items if x not in pair], 19, 0.9) for pair in itertools.combinations(items, 2)]
    df = spark.createDataFrame(sets, "tenant_id int, items array<string>, n_items int, support double")
    rules = bk.association_rules(df, 0.8)
    assert rules.filter("size(consequent) = 1 and size(antecedent) = 20").count() == 21
    assert rules.filter("size(consequent) > 1").count() == 0


def test_empty_baskets_and_no_frequent_sets(spark):
    tx = spark.createDataFrame([], "tenant_id int, order_id string, product_code string")
    sets = bk.frequent_itemsets(bk.baskets(tx), 0.1)
    assert sets.count() == 0 and bk.association_rules(sets, 0.1).count() == 0
    assert bk.frequent_itemsets(bk.baskets(tx, ()), 0.1, keys=()).count() == 0
    lone = spark.createDataFrame([(1, f"o{i}", f"p{i}") for i in range(20)], tx.schema)
    sets = bk.frequent_itemsets(bk.baskets(lone), 0.5)
    assert sets.count() == 0 and bk.association_rules(sets, 0.1).count() == 0


def test_every_tenant_has_a_status(spark):
    from shopsight.plans import jobs
    rows = [(1, f"o{i}", p) for i in range(12) for p in "ab"]                    # done
    rows += [(2, f"o{i}", p) for i in range(9) for p in "ab"]                    # too few orders
    rows += [(3, f"o{i}", f"p{i}") for i in range(12)]                           # nothing frequent
    rows += [(4, f"o{i}", "a") for i in range(12)]                               # frequent, but no rule
    tx = spark.createDataFrame(rows, "tenant_id int, order_id string, product_code string")
    tenants = spark.createDataFrame([(i,) for i in range(1, 6)], "tenant_id int")
    headers, _ = jobs.run_basket(tx, min_support=0.5)
    got = {r.tenant_id: (r.status, r.reason, r.n) for r in jobs.basket_status(tx, headers, tenants).collect()}
    none = "no frequent itemset or no rule"
    assert got == {1: ("done", None, 12), 2: ("skipped", "fewer than 10 orders", 9), 3: ("skipped", none, 12),
                   4: ("skipped", none, 12), 5: ("skipped", "fewer than 10 orders", 0)}


def _plain(tx, min_support):
    """{tenant: {items: freq}} of a list of (tenant, order, item)."""
    orders = {}
    for t, o, i in tx:
        orders.setdefault(t, {}).setdefault(o, set()).add(i)
    return {t: _brute([sorted(b) for b in by.values()], min_support)[0] for t, by in orders.items()}


def _mined(spark, tx, min_support):
    df = spark.createDataFrame(tx, "tenant_id int, order_id string, product_code string")
    got = {}
    for r in bk.frequent_itemsets(bk.baskets(df), min_support).collect():
        assert r["items"] == sorted(r["items"]) and r.n_items == len(r["items"]) and r.support == r.freq / r.n_orders
        got.setdefault(r.tenant_id, {})[tuple(r["items"])] = r.freq
    return got


def test_itemsets_of_5000_tenants(spark):
    import random
    rng = random.Random(4)
    tx = [(t, f"o{o}", f"p{int(8 * rng.random() ** 2)}") for t in range(5000) for o in range(rng.randint(1, 5))
          for _ in range(rng.randint(1, 4))]
    want = {t: s for t, s in _plain(tx, 0.4).items() if s}
    assert _mined(spark, tx, 0.4) == want


def test_itemsets_of_a_tenant_with_a_third_of_the_orders(spark, monkeypatch):
    """Many blocks and shards, which hold more orders than a block has places."""
    import random

    from shopsight.operators import itemsets
    monkeypatch.setattr(itemsets, "SHARD", 1500)
    rng = random.Random(6)
    sizes = {0: 9000, **{t: 900 for t in range(1, 21)}}
    tx = [(t, f"o{o}", f"p{int(12 * rng.random() ** 2)}") for t, n in sizes.items() for o in range(n)
          for _ in range(rng.randint(1, 5))]
    assert _mined(spark, tx, 0.05) == _plain(tx, 0.05)


def test_itemsets_of_a_very_large_order(spark):
    tx = [(1, "big", f"p{i:05d}") for i in range(20_000)] + [(1, f"o{o}", f"p{i:05d}") for o in range(30) for i in range(3)]
    got = _mined(spark, tx, 0.5)[1]
    assert got == {c: 31 for k in (1, 2, 3) for c in itertools.combinations(["p00000", "p00001", "p00002"], k)}


def test_itemsets_without_keys_and_null_tenants(spark):
    df = spark.createDataFrame([(None, "o1", "a"), (1, "o1", "a"), (1, "o1", "b")],
                               "tenant_id int, order_id string, product_code string")
    assert {tuple(r["items"]): r.freq for r in bk.frequent_itemsets(bk.baskets(df.filter("tenant_id = 1"), ()), 0.5,
                                                                    ()).collect()} == {
        ("a",): 1, ("b",): 1, ("a", "b"): 1}
    assert {r.tenant_id for r in bk.frequent_itemsets(bk.baskets(df), 0.5).collect()} == {1}
