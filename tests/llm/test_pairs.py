"""Near-duplicates, format duplicates, shared spans and leaked items against brute force, with odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import format_duplicates as fd
from millrace.llm.leakage import leaked_items
from millrace.llm.near_duplicates import class_links, similar_groups, similar_pairs
from millrace.llm.shared_spans import shared_chars, shared_spans


def shingles(text, n):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(words) for _ in range(rng.randint(1, 8))]
        out.append((i, " ".join(t)))
    # a third of the rows are one text, some of it edited
    hot = " ".join(rng.choice(words) for _ in range(60))
    out += [(n + i, hot + (f" tail{i % 7}" if i % 3 else "")) for i in range(n // 2)]
    return out + [(10_000, None), (10_001, ""), (10_002, "   \n"), (10_003, "x" * 200_000 + " long word"), (10_004, "one two"), (10_005, "One, two!")]


@pytest.mark.parametrize("n,share,hot,block", [(3, "0.7", 10, 4), (5, "0.8", 2_000_000, 4096), (2, "0.5", 10, 4096)])
def test_pairs_are_exact(spark, n, share, hot, block):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "ord bigint, code string").withColumn("id", F.lit("clash")).withColumn("text", F.lit(1)).withColumn("fp", F.lit(2))
    got = [(r.id_a, r.id_b) for r in similar_pairs(df, "ord", "code", words=n, similarity=share, hot=hot, block=block).collect()]
    sets = {i: shingles(t, n) for i, t in rows}
    p, q = int(float(share) * 10), 10
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * q >= p * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_classes_and_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "A b c d e f g h i j k"), (3, "a b c d e f g h i j k l"), (4, None), (5, "other words stand here and nowhere else")], "i bigint, t string")
    got = {r.i: (r.class_id, r.copies, r.links) for r in class_links(df, "i", "t").collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1), 4: (None, 1, 0), 5: (5, 1, 0)}
    assert class_links(df.limit(0), "i", "t").count() == 0
    df = df.union(spark.createDataFrame([(6, "a b c d e f g h i j k l m"), (7, "")], df.schema))
    assert {r.i: (r.group_id, r.members) for r in similar_groups(df, "i", "t").collect()} == {1: (1, 4), 2: (1, 4), 3: (1, 4), 6: (1, 4), 4: (4, 1), 5: (5, 1), 7: (7, 1)}
    assert similar_groups(df.limit(0), "i", "t").count() == 0
    assert similar_pairs(df.where("i > 3"), "i", "t").count() == 0


def span_brute(rows, length):
    seen = {}
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            seen.setdefault(t[k : k + length], set()).add(i)
    out = {}
    for i, t in rows:
        end = n = 0
        for k in range(len(t or "") - length + 1):
            if len(seen[t[k : k + length]]) > 1:
                n += k + length - max(end, k)
                end = k + length
        if n:
            out[i] = n
    return out


@pytest.mark.parametrize("bound", [64, 1])
@pytest.mark.parametrize("length", [30, 200])
def test_spans_are_exact(spark, length, bound):
    rng = random.Random(length)
    alphabet = "ab cdéß漢😀\n"
    fresh = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [fresh(rng.randint(length - 5, 3 * length)) for _ in range(6)]
    rows = [(i, fresh(rng.randint(0, 2 * length)) + "".join(rng.choice(shared) + fresh(rng.randint(0, 40)) for _ in range(rng.randint(0, 3)))) for i in range(50)]
    rows += [(100 + i, shared[0] + "!" * 5) for i in range(25)] + [(200, None), (201, ""), (202, "z" * (5 * length)), (203, "z" * (3 * length)), (204, "y" * (4 * length))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc", F.lit("clash"))
    got = {r.doc_id: r.shared_chars for r in shared_chars(df, "doc_id", "text", length=length, group_bound=bound).collect()}
    assert got == span_brute(rows, length)
    spans = shared_spans(df, "doc_id", "text", length=length).collect()
    assert all(r.stop - r.start >= length for r in spans)


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_chars(df, "doc_id", "text").count() == 0


def windows(t, n=13):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_leaks(spark, bound):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(300)] + ["Zürich", "naïve", "42", "kb"]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(20)] + [(50, None), (51, "too short"), (52, "")]
    docs = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(40))
        if i % 3 == 0:
            w = items[rng.randrange(20)][1].split()
            k = rng.randint(10, 20)
            t += " / ".join(["", *w[3 : 3 + k], ""]).upper() + t
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, items[0][1] * 3)]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(d, "doc_id", "text", q, "item_id", "text", bound=bound).where("verbatim > 0").collect()}
    assert got == {(a, b) for a, t in docs for b, u in items if windows(t) & windows(u)}


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_reworded_leak(spark, bound):
    train = "A train of NorthLine travels 120 km in 3 hours. How long does the train of NorthLine need for 200 km when it waits at the station and then starts again with the same speed"
    code = "Write for RouteFinder helper that lists open orders by date and returns newest"
    shop = "On the way home Maria Lopez bought seven apples, then paid 4 dollars for the rest of the fruit in the shop"
    same = "they counted 12 boxes and sold 12 boxes before the rain came down over the whole of the town"
    docs = {
        1: train.replace("120", "75").replace("200", "310").replace("NorthLine", "SouthLine"),
        2: code.replace("RouteFinder", "PathFinder"),  # a name no item holds
        3: shop.replace("Maria Lopez", "Erik").replace("4 dollars", "900 cents"),  # two words by one, another unit
        4: same.replace("sold 12", "sold 15"),  # one value for two
        5: same.replace("12", "80"), 6: train.lower(), 7: "nothing of it", 8: None, 9: "", 10: code.replace("lists", "drops"),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    q = spark.createDataFrame([(21, train), (22, code), (23, shop), (24, same), (25, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.verbatim > 0, r.reworded > 0) for r in leaked_items(d, "doc_id", "text", q, "item_id", "text", bound=bound).collect()}
    assert got == {(1, 21): (True, True), (2, 22): (False, True), (3, 23): (False, True), (5, 24): (False, True), (6, 21): (True, False)}
    assert leaked_items(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0


def test_windows_of_placeholders_alone(spark):
    numbers = lambda k: " ".join(str(k * 100 + i) for i in range(30))
    d = spark.createDataFrame([(i, numbers(i)) for i in range(40)], "doc_id bigint, text string")
    q = spark.createDataFrame([(3, numbers(3)), (99, numbers(99))], "item_id bigint, text string")
    got = [tuple(r) for r in leaked_items(d, "doc_id", "text", q, "item_id", "text").collect()]
    assert got == [(3, 3, 18, 0)]


A = """def f(x):
    h = {"b": 1, "a": {"z": 2, "y": [1, 2]}}
    return requests.get(url, params=h, headers={"k": "v, w"}, timeout=3)
"""


@pytest.mark.parametrize(
    "b,same",
    [
        (A.replace("    ", "\t").replace('"', "'").upper(), True),
        (A.replace('{"b": 1, "a": {"z": 2, "y": [1, 2]}}', '{\n"a": {"y": [1, 2], "z": 2,}, "b": 1}'), True),
        (A.replace("params=h, headers=", "headers=").replace('"}, timeout=3', '"}, timeout=3, params=h'), True),
        (A.replace("[1, 2]", "[2, 1]"), False),
        (A.replace("def f(x)", "def f(y)"), False),
        (A.replace("get(url, ", "get("), False),
    ],
)
def test_canonical_code(b, same):
    assert (fd.canonical_code(A) == fd.canonical_code(b)) is same


def test_copies_and_ledger(spark):
    rows = [(5, "getX", "a/b.py", A), (2, "get_x", "A\\B.py", A.upper()), (9, "getx", "./a/b.py", A.replace(" ", "")), (1, "other", "a/b.py", A), (3, None, None, A), (4, None, "", A), (6, "n", "p", None), (7, "n", "p", "")]
    df = spark.createDataFrame(rows, "ord bigint, function_name string, path string, code string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(0))
    for batches in (1, 3):
        ledger, found = fd.copies(df, "ord", "function_name", "path", "code", batches=batches)
        assert {(r.first_id, r.id) for r in found.collect()} == {(2, 5), (2, 9), (3, 4)}
        assert {(r.first_id, r.copies) for r in ledger.collect()} == {(2, 3), (1, 1), (3, 2), (7, 1)}
    assert fd.copies(df.limit(0), "ord", "function_name", "path", "code")[1].count() == 0


def test_ledger_lasts(spark, tmp_path):
    first = spark.createDataFrame([(5, b"a"), (7, b"a"), (8, b"b")], "id bigint, key binary")
    second = spark.createDataFrame([(2, b"a"), (9, b"c")], "id bigint, key binary")
    third = spark.createDataFrame([(1, b"c")], "id bigint, key binary")
    folder = f"file://{tmp_path}/ledger"
    ledger = fd.Ledger(spark, folder, buckets=8)
    assert ledger.rows().count() == 0
    ledger.add(first, "monday")
    ledger.add(second, "tuesday")
    # Another session opens the folder; a repeated batch changes nothing.
    again = fd.Ledger(spark.newSession(), folder)
    again.add(second, "tuesday")
    again.add(third, "wednesday")
    again.add(third.limit(0), "thursday")
    again.clean()
    want = {(b"a", 3, 2), (b"b", 1, 8), (b"c", 2, 1)}
    last = fd.Ledger(spark, folder)
    assert {(bytes(r.key), r.copies, r.first_id) for r in last.rows().collect()} == want
    assert last.batches == ["monday", "tuesday", "wednesday", "thursday"]
    # Only the buckets of a batch's keys are rewritten, and a writer who comes too late is refused.
    touched = {r.bucket for r in last.rows().where("copies = 2").collect()}
    before = dict(last._state["at"])
    late = fd.Ledger(spark, folder)
    last.add(third, "friday")
    assert {b for b, f in last._state["at"].items() if before[b] != f} == {str(b) for b in touched}
    with pytest.raises(RuntimeError):
        late.add(first, "friday")
    assert {r.copies for r in fd.Ledger(spark, folder).rows().collect()} == {3, 1}


def test_calls_behind_long_names():
    name = "client_" + "x" * 300
    assert fd.canonical_code(f"{name}(b=1, a=2)") == fd.canonical_code(f"{name}(a=2, b=1)")
    assert fd.canonical_code(f"def {name}(b=1, a=2):\n    pass") != fd.canonical_code(f"def {name}(a=2, b=1):\n    pass")
    assert fd.canonical_code("x = defaults(b=1, a=2)") == fd.canonical_code("x = defaults(a=2, b=1)")
