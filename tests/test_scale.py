"""Operators that must hold when one key has a third of all rows or more, against plain loops."""

import datetime as dt
import heapq
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from chainlens.functions import predicates as P
from chainlens.operators import allocation, context, observed, quality, risks, shipments, slices
from chainlens.operators.cascade import cascade, closure_order
from chainlens.operators.trigrams import SubstringIndex
from chainlens.schema import SCHEMAS
from chainlens.sources import star
from chainlens.streaming import risk_state
from tests.fixture import AS_OF, make_tables


@pytest.fixture(scope="module")
def t(spark):
    return make_tables(spark)


@pytest.fixture(autouse=True)
def small_partitions(spark):
    """Partitions of a small table stay apart, as those of a large one do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


# -- slices ------------------------------------------------------------------------


def keyed(n, seed=1):
    """(key, seq, v): a third of the rows, and more, under key 0; some under no key."""
    r = random.Random(seed)
    return [(r.choice([0, 0, 0, None, *range(1, 9)]), i, r.randint(0, 9)) for i in range(n)]


def test_slices_carry_over(spark):
    rows = keyed(2000)
    x = slices.in_slices(spark.createDataFrame(rows, "key long, seq long, v int").repartition(7), "key", "seq")
    assert x.filter("key = 0").select(slices.SLICE).distinct().count() > 1      # the hot key spreads
    got = slices.sum_before(slices.previous(x, "key", "v", "before"), "key", F.col("v"), "sum_before").collect()
    want, last, total = {}, {}, {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        want[seq] = (last.get(k), total.get(k, 0))
        last[k], total[k] = v, total.get(k, 0) + v
    assert {r.seq: (r.before, r.sum_before) for r in got} == want


def test_dense_numbers(spark, t):
    rows = spark.createDataFrame(keyed(500), "key long, seq long, v int").repartition(5)
    first, again = (slices.numbered(d, ["key", "seq"], "id", 40) for d in (rows, rows.repartition(3)))
    got = {r.seq: r.id for r in first.collect()}
    assert sorted(got.values()) == list(range(41, 541)) and got == {r.seq: r.id for r in again.collect()}
    assert slices.numbered(rows.limit(0), ["key", "seq"], "id").count() == 0
    new = risks.number_risks(t.risk_event, risks.detect_risks(t))
    assert sorted(r.risk_id for r in new.collect()) == [7, 8, 9, 10]
    rows = new._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    assert "Window" not in rows and "SinglePartition" not in rows.split("Subquery")[0]
    empty = risks.number_risks(t.risk_event.limit(0), risks.detect_risks(t.replace(risk_event=t.risk_event.limit(0))))
    assert min(r.risk_id for r in empty.collect()) == 1


# -- M5: a hot shipment ------------------------------------------------------------


def test_status_changes_of_a_hot_shipment(spark, t):
    r = random.Random(2)
    kinds = ["In Transit", "Delivered", "Delayed", "Cancelled", "Lost", None]
    rows = [(i, r.choice([5000, 5000, 5000, 5001, 5004, 77]), r.choice(kinds)) for i in range(1500)]
    updates = spark.createDataFrame(rows, "seq long, shipment_id long, new_status string").repartition(6)
    now = {s.shipment_id: s.shipment_status for s in t.shipment.collect()}
    want = []
    for seq, ship, status in rows:
        if ship in now and status in kinds[:4]:
            want.append((seq, ship, now[ship], status))
            now[ship] = status
    assert sorted(map(tuple, shipments.status_changes(t.shipment, updates).collect())) == want


# -- M1: a hot product -------------------------------------------------------------


def fold_by_hand(requests, stock, companies):
    rows = {}
    for inv, product, qty in stock:
        if qty is not None:
            heapq.heappush(rows.setdefault(product, []), (-qty, inv))
    out = {}
    for seq, company, product, want, _ in sorted(requests):
        heap = rows.get(product)
        if not heap:
            out[seq] = ("rejected", "no inventory", None)
        elif want > -heap[0][0]:
            out[seq] = ("rejected", "insufficient stock", None)
        elif want <= 0 or company not in companies:
            out[seq] = ("rejected", "invalid request", None)
        else:
            q, inv = heap[0]
            heapq.heapreplace(heap, (q + want, inv))
            out[seq] = ("accepted", None, inv)
    return out, {inv: -q for heap in rows.values() for q, inv in heap}


@pytest.mark.parametrize("block", [40, 100_000])
def test_allocation_of_a_hot_product(spark, t, block):
    """One product with half of all requests, in many rounds, in a few, and in one fold."""
    r = random.Random(4)
    requests = [(i, r.choice([1, 2, 9]), r.choice([100, 100, 101, 102]), r.choice([1, 1, 2, 3, 7, 40, 0]), "Low") for i in range(500)]
    stock = [(1, 100, 60), (2, 100, 60), (3, 100, 35), (4, 101, 60), (5, 101, None), (6, 102, 400)]
    inventory = spark.createDataFrame([(i, p, 1, q, 0, None, 10, "In Stock") for i, p, q in stock], SCHEMAS["inventory"])
    x = t.replace(order_request=spark.createDataFrame(requests, SCHEMAS["order_request"]).repartition(5), inventory=inventory)
    decisions, orders, after, changes = allocation.allocate_orders(x, block=block)
    want, left = fold_by_hand(requests, stock, {1, 2, 3})
    rows = decisions.collect()
    assert len(rows) == len(requests) and {d.seq: (d.status, d.reason, d.inventory_id) for d in rows} == want
    assert {i.inventory_id: i.quantity_available for i in after.collect()} == {**{5: None}, **left}
    assert orders.count() == changes.count() == sum(v[0] == "accepted" for v in want.values())


def test_rounds_are_bounded(spark):
    rows = spark.createDataFrame([(1, b) for b in range(10) for _ in range(b % 4)] + [(2, 3)] * 7, "product_id long, block long")
    chosen = {tuple(r) for r in allocation.next_blocks(rows, 7).collect()}
    assert chosen == {(1, 1), (1, 2), (1, 3), (1, 5), (2, 3)}


def test_a_round_folds_no_more_than_a_block(spark, t, monkeypatch):
    sizes = []
    inner = allocation._folded
    monkeypatch.setattr(allocation, "_folded", lambda asks, stock: sizes.append(
        max([r["count"] for r in asks.groupBy("product_id").count().collect()], default=0)) or inner(asks, stock))
    requests = spark.createDataFrame([(i, 1, 100, 1 + i % 4, "Low") for i in range(500)], SCHEMAS["order_request"])
    inventory = spark.createDataFrame([(1, 100, 1, 250, 0, None, 10, "In Stock")], SCHEMAS["inventory"])
    allocation.allocate_orders(t.replace(order_request=requests, inventory=inventory), block=50)[0].count()
    assert len(sizes) > 3 and max(sizes) <= 50
    assert sum(sizes) < 500        # what comes after the stock is gone is not folded


# -- E3: state in buckets ----------------------------------------------------------


def files_under(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_a_batch_writes_its_own_buckets(spark, tmp_path):
    keys = [("Inventory", i, "Low Stock") for i in range(3000)]
    state = risk_state.OpenCounts(spark, str(tmp_path), 30)
    state.write(spark.createDataFrame([(*k, 1) for k in keys], risk_state.COUNT_SCHEMA), 0, {})
    whole = sum(files_under(f"{tmp_path}/buckets/v=0").values())
    events = spark.createDataFrame([(1, *keys[5], 1, None, None)], risk_state.EVENT_SCHEMA)
    for _ in range(2):     # a replayed batch starts from the same state
        touched = state.touched(events)
        assert len(touched) == 1
        before = state.read(0, touched)
        assert before.count() < 300
        after = risk_state._advance(events, before).select(*risk_state.KEY, "open_risks")
        state.write(after, 1, state.versions(0))
        assert sum(files_under(f"{tmp_path}/buckets/v=1").values()) < whole / 10
    rows = {r.entity_id: r.open_risks for r in state.read(1, range(30)).collect()}
    assert len(rows) == 3000 and rows[5] == 0 and sum(rows.values()) == 2999


@pytest.mark.parametrize("keys_per_bucket", [1, 50])
def test_stream_in_buckets_equals_one_bucket(spark, keys_per_bucket):
    r = random.Random(8)
    rows = [(i, "Inventory", r.randrange(40), "Low Stock", int(r.random() < 0.4), "High", f"e{i}") for i in range(600)]
    events = spark.createDataFrame(rows, risk_state.EVENT_SCHEMA)
    initial = spark.createDataFrame([("Inventory", i, "Low Stock", i % 3) for i in range(60)], risk_state.COUNT_SCHEMA)
    got = risk_state.run_risk_state_stream(spark, events, initial, AS_OF, slices=4, rows_per_file=100, keys_per_bucket=keys_per_bucket)
    counts, want = {i: i % 3 for i in range(60)}, set()
    for seq, _, key, _, closes, _, text in rows:
        if closes:
            counts[key] = max(0, counts[key] - closes)
        elif counts[key] == 0:
            counts[key] = 1
            want.add((seq, text))
    assert {(x.seq, x.description) for x in got.collect()} == want


def test_stream_of_a_hot_key(spark):
    """One key with most events: its epochs lie in several slices, and what it fires equals the loop."""
    r = random.Random(12)
    rows = [(i, "Inventory", r.choice([1, 1, 1, 2, 3]), "Low Stock", r.choice([0, 0, 0, 1, 2]), "High", f"e{i}") for i in range(2000)]
    events = spark.createDataFrame(rows, risk_state.EVENT_SCHEMA).repartition(5)
    x = slices.in_slices(events.select("entity_id", "seq"), "entity_id", "seq")
    assert x.filter("entity_id = 1").select(slices.SLICE).distinct().count() > 1
    before = {1: 100, 2: 0, 4: 3}
    counts = spark.createDataFrame([("Inventory", i, "Low Stock", n) for i, n in before.items()], risk_state.COUNT_SCHEMA)
    now, want = dict(before), set()
    for seq, _, key, _, closes, _, _ in rows:
        if closes:
            now[key] = max(0, now.get(key, 0) - closes)
        elif now.get(key, 0) == 0:
            now[key] = 1
            want.add((seq, key))
    epochs = risk_state._epochs(events)
    assert {(x.seq, x.entity_id) for x in risk_state._created(epochs, counts).collect()} == want
    assert {x.entity_id: x.open_risks for x in risk_state._counted(epochs, counts).collect()} == now


# -- C3: a long conversation -------------------------------------------------------


def test_pairs_of_a_hot_conversation(spark):
    r = random.Random(4)
    rows = [(c, turn, r.choice(["user", "assistant", "assistant", "system", None]), r.choice([None, "", f"t{c}.{turn}"]))
            for c, n in ((1, 3000), (2, 9), (3, 1), (4, 40), (None, 6)) for turn in r.sample(range(2 * n), n)]
    conv = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(6)
    want = set()
    for c in (1, 2, 3, 4):
        turns = sorted(((turn, role, text) for k, turn, role, text in rows if k == c), key=lambda x: x[0])
        users = [x[0] for x in turns if x[1] == "user"]
        old = [x for x in turns if users and x[0] < users[-1]]
        pairs = [(x, old[i + 1] if i + 1 < len(old) else None) for i, x in enumerate(old) if x[1] == "user"][-6:]
        for i, (x, after) in enumerate(pairs):
            answer = (after[2] or "") if after and after[1] == "assistant" else ""
            want.add((c, x[0], x[2], answer, 6 - len(pairs) + i + 1))
    df = context.conversation_pairs(conv)
    got = df.select("conv_id", "user_turn", "user_text", "assistant_text", "pair_no").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


# -- C2: text of a large tenant ----------------------------------------------------


def test_chunks_of_a_hot_tenant(spark):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randint(1, 3), "s", i, "é" * r.choice([0, 3, 40, 90])) for i in range(900)]
    rows += [(3, 1, "s", 1, "x" * 1000), (3, 2, "s", 1, "after a long line")]
    lines = spark.createDataFrame(rows, "company_id long, section_order int, section string, line_key long, line string").repartition(6)
    got = context.document_chunks(lines, 200).collect()
    whole = {k: "\n".join(x[4] for x in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[3]))) for k in (1, 2, 3, None)}
    for company, text in whole.items():
        own = sorted((c for c in got if c.company_id == company), key=lambda c: c.chunk_no)
        assert "\n".join(c.text for c in own) == text
        assert all(len(c.text) <= 200 + 1000 for c in own) and len({c.chunk_no for c in own}) == len(own)
        if company != 3:
            assert [c.chunk_no for c in own] == list(range(len(own))) and max(len(c.text) for c in own) < 290
    assert sum(c.n_lines for c in got) == len(rows)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_chunks_deal_the_lines_once_and_leave_no_shuffle(spark):
    lines = spark.createDataFrame([(i % 3, 1, "s", i, "x" * (i % 50)) for i in range(600)],
                                  "company_id long, section_order int, section string, line_key long, line string")
    before = shuffle_files(spark)
    chunks = context.document_chunks(lines, 200)
    assert not shuffle_files(spark) - before
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_sums_of_slices_are_those_of_windows(spark):
    rows = [(k, seq, None if v == 3 else v) for k, seq, v in keyed(2000)]
    df = spark.createDataFrame(rows, "key long, seq long, v int").repartition(7)
    want = slices.sum_before(slices.in_slices(df, "key", "seq"), "key", F.col("v"), "before")
    got = slices.in_slices_summed(df, F.col("v"), "before", "key", "seq")
    assert {r.seq: r.before for r in got.collect()} == {r.seq: r.before for r in want.collect()}


def test_prompt_carries_its_context(spark, t):
    owners = spark.createDataFrame([(1, 2), (2, 99)], "conv_id long, company_id long")
    got = context.prompt_contents(t, owners, 80).orderBy("position", "part").collect()
    preamble = context.assemble_documents(context.prompt_preamble(t)).filter("company_id = 2").first().document
    first = [r.text for r in got if (r.conv_id, r.position) == (1, 1)]
    assert len(first) > 3 and "\n".join(first) == preamble and preamble.endswith("User's role: company, Company ID: 2")
    assert [r.text for r in got if (r.conv_id, r.position) == (2, 1)] == ["# Live Database Context"]     # no such company
    assert [r.text for r in got if r.conv_id == 1 and r.position > 1] == [
        r.text for r in context.prompt_turns(t.conversations).filter("conv_id = 1 AND position > 1").orderBy("position").collect()]


def test_equal_chunks_lie_side_by_side(spark, t):
    conv = spark.createDataFrame([(c, 0, "user", "hi") for c in range(12)], SCHEMAS["conversations"])
    owners = spark.createDataFrame([(c, 1 + c % 2) for c in range(12)], "conv_id long, company_id long")
    got = [r for r in context.prompt_contents(t.replace(conversations=conv), owners, 80).collect() if r.position == 1]
    runs = [(a.conv_id % 2, a.part) for a, b in zip(got, [None, *got]) if b is None or (a.conv_id % 2, a.part) != (b.conv_id % 2, b.part)]
    assert len(got) == 6 * len(runs) and len(set(runs)) == len(runs) > 6


# -- F7 / F9: the index ------------------------------------------------------------


def test_index_equals_the_scan(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice("abAB_%é ") for _ in range(r.choice([0, 1, 2, 5, 30]))), r.choice([None, "Ring Ab", "a", "bab"]), i % 50)
            for i in range(800)]
    df = spark.createDataFrame(rows, "id long, name string, other string, n int")
    one = SubstringIndex(df, "id", ["name", "other"])
    row = SubstringIndex(df, "id", ["n", "name", "other"], whole_row=True)
    needles = [None, "", "nowhere at all"]
    for size in range(1, 11):
        text = rows[r.randrange(len(rows))][1] + "abab bA_%é ABa"
        needles += [text[:size], "Ring Ab ring"[:size], "".join(r.choice("ab") for _ in range(size))]
    for needle in needles:
        for index, hit in ((one, P.search(needle, "name", "other")), (row, P.row_search(needle, ["n", "name", "other"]))):
            assert sorted(x.id for x in index.search(needle).collect()) == sorted(x.id for x in df.filter(hit).collect()), needle


def test_a_search_reads_the_folders_of_its_grams(spark):
    df = spark.createDataFrame([(i, f"item {i:05d}") for i in range(300)], "id long, name string")
    index = SubstringIndex(df, "id", ["name"])
    assert [r.id for r in index.search("00123").collect()] == [123]
    plan = index.candidates("00123")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan or "PartitionFilters: [isnotnull(folder" in plan
    assert "PushedFilters: [In(gram" in plan


# -- Q5: any graph -----------------------------------------------------------------


def test_cascade_over_a_diamond(spark):
    def table(cols, rows):
        return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols.split()))

    tables = {"a": table("a_id", [(1,), (2,), (3,)]),
              "b": table("b_id a_id", [(10, 1), (11, 2), (12, None), (13, 77)]),
              "c": table("c_id a_id", [(20, 2), (21, 3), (22, 1)]),
              "d": table("d_id b_id c_id", [(30, 10, 21), (31, 11, 20), (32, 12, 21), (33, 11, 22), (34, None, None), (35, 13, 21)]),
              "e": table("e_id d_id b_id", [(40, 30, 10), (41, 32, 10), (42, 32, None), (43, 33, 11)]),
              "f": table("f_id e_id", [(50, 40), (51, 42), (52, 41)])}
    keys = {n: f"{n}_id" for n in tables}
    fks = [("e", "d_id", "d", "d_id", "cascade"), ("e", "b_id", "b", "b_id", "set_null"), ("d", "b_id", "b", "b_id", "cascade"),
           ("d", "c_id", "c", "c_id", "cascade"), ("b", "a_id", "a", "a_id", "cascade"), ("c", "a_id", "a", "a_id", "cascade"),
           ("f", "e_id", "e", "e_id", "no_action")]
    assert [g for g in closure_order(fks)][0] == ["a"] and closure_order(fks).index(["d"]) > closure_order(fks).index(["c"])
    after, blocked = cascade(tables, fks, keys, {"a": tables["a"].filter("a_id = 1")})
    got = {n: sorted(map(tuple, df.collect()), key=str) for n, df in after.items()}
    assert got["a"] == [(2,), (3,)] and got["b"] == [(11, 2), (12, None), (13, 77)] and got["c"] == [(20, 2), (21, 3)]
    assert got["d"] == [(31, 11, 20), (32, 12, 21), (34, None, None), (35, 13, 21)]      # by either parent
    assert got["e"] == [(41, 32, None), (42, 32, None)]                                  # 40, 43 go; 41 loses its reference
    assert [tuple(r) for r in blocked.collect()] == [("f", "e_id", 1)] and "f" not in after


def test_cascade_in_a_circle(spark):
    """Employees whose chiefs are employees, and teams that are led by one and have members."""
    staff = spark.createDataFrame([(1, None, 100), (2, 1, 101), (3, 2, 102), (4, 4, 103), (5, 3, 104), (6, None, 103), (7, None, 200)],
                                  "id long, chief long, team long")
    team = spark.createDataFrame([(100, None), (101, None), (102, None), (103, 5), (104, None), (200, 7)], "team long, lead long")
    fks = [("staff", "chief", "staff", "id", "cascade"), ("staff", "team", "team", "team", "cascade"), ("team", "lead", "staff", "id", "cascade")]
    after, blocked = cascade({"staff": staff, "team": team}, fks, {"staff": "id", "team": "team"}, {"staff": staff.filter("id = 1")})
    # 1 -> 2 -> 3 -> 5 -> team 103 -> 4, 6
    assert sorted(r.id for r in after["staff"].collect()) == [7]
    assert sorted(r.team for r in after["team"].collect()) == [100, 101, 102, 104, 200] and blocked is None


# -- Q2 / Q3 beside the write ------------------------------------------------------


def test_checks_ride_on_the_write(spark, t, tmp_path):
    from pyspark.sql import Observation
    bad = spark.createDataFrame([(10, "x" * 200, 1, None, -1, None, None, True), (99, "ok", 1, None, 3, None, None, True),
                                 (99, "ok", 2, None, 3, None, None, True), (99, "ok", 2, None, 3, None, None, True)], SCHEMAS["supplier"])
    rows = t.supplier.unionByName(bad)
    rules, keys = observed.write_checked(rows, "supplier", f"{tmp_path}/supplier.parquet")
    want = {r.rule: r.violations for r in quality.check_violation_counts(t.replace(supplier=rows)).filter("table_name = 'supplier'").collect()}
    assert {rule: n for _, rule, n in rules} == want and want["lead_time_days >= 0"] == 1 and want["supplier_name length <= 150"] == 1
    assert keys == [("supplier", "supplier_id", 2)]
    back = spark.read.parquet(f"{tmp_path}/supplier.parquet")
    assert back.columns == rows.columns and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    plan = observed.checked(back, "supplier", Observation())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


# -- S4: nothing is left out -------------------------------------------------------


def test_json_keeps_nulls_and_decimals(spark, t, tmp_path):
    rows = {r.product_id: json.loads(r.json) for r in quality.to_json_rows(t.product, "product_id").collect()}
    assert rows[100]["weight_kg"] is None and "weight_kg" in rows[100] and rows[100]["unit_price"] == 9.99
    assert set(rows[100]) == set(t.product.columns)
    late = {r.shipment_id: json.loads(r.json) for r in quality.to_json_rows(t.shipment, "shipment_id").collect()}
    assert late[5000]["actual_delivery_date"] is None and late[5003]["actual_delivery_date"] == dt.date(2026, 2, 2).isoformat()
    quality.write_json(t.product, f"{tmp_path}/json")
    told = [json.loads(line) for f in os.listdir(f"{tmp_path}/json") if f.endswith(".json") for line in open(f"{tmp_path}/json/{f}")]
    assert len(told) == 3 and all("weight_kg" in r for r in told)


# -- M1: tasks that follow the number of rows; Q4: keys alone -----------------------


def test_the_fold_has_tasks_by_its_rows(spark, t, monkeypatch):
    r = random.Random(12)
    stock = spark.createDataFrame([(i, i % 60, 1, r.randint(0, 90), 0, None, 5, "In Stock") for i in range(120)], SCHEMAS["inventory"])
    product = spark.createDataFrame([(i, "p", 10, None, None, None, None, True) for i in range(60)], SCHEMAS["product"])
    asks = spark.createDataFrame([(i, 1, r.choice([*range(62), None]), r.choice([None, 0, 1, 5, 30, 200]), None) for i in range(900)],
                                 SCHEMAS["order_request"])
    want = allocation.run_allocation(asks, stock, t.company, product)
    monkeypatch.setattr(allocation, "PER_TASK", 30)
    got = allocation.run_allocation(asks, stock, t.company, product)
    tasks = re.search(r"hashpartitioning\(product_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())
    assert int(tasks[1]) >= 10
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dangling_refs_build_no_entity_table(spark, t):
    def refuse(name):
        raise AssertionError(f"{name} was built for its keys")

    names = [n for n, _ in quality.ENTITY_TABLES.values()]
    bare = t.with_factories({n: (lambda n=n: refuse(n)) for n in names}, {n: (lambda n=n: t[n]) for n in names})
    got = quality.risk_dangling_refs(bare).collect()
    assert sorted(r.risk_id for r in got) == sorted(r.risk_id for r in quality.risk_dangling_refs(t).collect()) == [3]
    gone = bare.replace(supplier=t.supplier.filter("supplier_id <> 10"))
    assert sorted(r.risk_id for r in quality.risk_dangling_refs(gone).collect()) == [3, 5]


# -- E3: what the order costs ------------------------------------------------------


def test_only_keys_with_closes_and_crossings_are_put_in_order(spark, monkeypatch):
    rows = [(s, "Inventory", k, "Low Stock", c, None if c else "High", f"e{s}") for s, k, c in (
        *[(i, 1, 0) for i in range(50)], (60, 2, 1), (61, 2, 2), (70, 3, 0), (71, 3, 1), (72, 3, 0), (73, None, 0), (74, None, 1))]
    seen = []
    inner = risk_state.in_slices
    monkeypatch.setattr(risk_state, "in_slices", lambda df, *a, **b: seen.append(df.count()) or inner(df, *a, **b))
    got = {(x.entity_id, x.epoch): x.e and x.e.seq for x in risk_state._epochs(spark.createDataFrame(rows, risk_state.EVENT_SCHEMA)).collect()}
    assert seen == [5]
    assert got == {(1, 0): 0, (2, 3): None, (3, 0): 70, (3, 1): 72, (None, 0): 73, (None, 1): None}


def small_star(spark, monkeypatch):
    """(mapping, lines): lines (order, part, supplier, quantity, day), most of them of part 1."""
    r = random.Random(3)
    lines = [(o, r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([1, 2, 3, 4]), float(r.randint(1, 50)) if r.random() < 0.6 else None,
              dt.datetime(1995, 1, 1) + dt.timedelta(days=r.randrange(200)) if o % 40 else None) for o in range(300)]
    frames = {
        "lineitem": spark.createDataFrame([(*x, 1, 2.0) for x in lines], "l_orderkey long, l_partkey long, l_suppkey long, "
                                          "l_quantity double, l_shipdate timestamp_ntz, l_linenumber int, l_extendedprice double"),
        "part": spark.createDataFrame([(1, 20), (2, None), (3, 30)], "p_partkey long, p_size int"),
        "supplier": spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1)], "s_suppkey long, s_nationkey int"),
        "nation": spark.createDataFrame([(1, 0), (2, 1), (3, None)], "n_nationkey int, n_regionkey int")}
    m = star.StarMapping(spark, "/none")
    monkeypatch.setattr(m, "raw", frames.__getitem__)
    return m, lines


@pytest.mark.parametrize("hot", [0, 60, 10_000])
def test_stock_log_of_hot_parts(spark, monkeypatch, hot):
    """Parts over and under the limit, against a loop.  A null day comes first in a row's order and is no update;
    the level is not known before a line of the month has a quantity."""
    monkeypatch.setattr(star, "HOT_LINES", hot)
    m, lines = small_star(spark, monkeypatch)
    stock, want = {}, set()
    region, threshold = {1: 0, 2: 1, 4: 0}, {1: 40, 2: None, 3: 60}
    for o, p, s, q, day in sorted(lines, key=lambda x: (x[-1] or dt.datetime.min, x[0])):
        if p is None or s not in region:
            continue
        k = p * 5 + region[s]
        n, level, known = stock.get(k, (0, 0, None))
        month = day and (day.year, day.month)
        known = known if q is None else month
        stock[k] = n + 1, level + int(q or 0), known
        if n and day:
            now = level + int(q or 0) if known == month else None
            old = None if now is None or q is None else now - int(q)
            want.add((n + 1, k, *(None if v is None else v % 97 for v in (old, now)), threshold[p], threshold[p]))
    got = [tuple(x) for x in m.inventory_change().collect()]
    assert len(got) == len(want) > 150 and set(got) == want


def test_stock_log_is_dealt_once(spark, monkeypatch):
    """The join deals the lines by part; only hot parts are dealt again, by stock row."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = small_star(spark, monkeypatch)[0].inventory_change()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    whole = plan[plan.index("Union"):plan.index("SortMergeJoin [inventory_id")]     # the branch before that of hot parts
    assert "hashpartitioning(l_partkey" in whole and "hashpartitioning(inventory_id" not in whole
