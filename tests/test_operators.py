"""Operators against plain walks over the same rows."""

import difflib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import audit, dedupe, metrics, select


def test_balanced_selection(spark):
    def walk(rows, caps, target):
        taken, skipped, n = [], [], [{} for _ in caps]
        for r in rows:
            if len(taken) >= target:
                skipped.append(r)
                continue
            if all(n[i].get(r[i + 1], 0) < c for i, c in enumerate(caps)):
                taken.append(r)
                for i in range(len(caps)):
                    n[i][r[i + 1]] = n[i].get(r[i + 1], 0) + 1
            else:
                skipped.append(r)
        more = [r for r in skipped][: target - len(taken)]
        return {r[0] for r in taken}, {r[0] for r in more}

    rng = random.Random(5)
    for target, caps in ((3, (2, 2)), (60, (3, 4)), (500, (3, 4))):
        rows = [(i, rng.choice("AABC"), rng.choice("wxyz")) for i in range(90)]
        df = spark.createDataFrame([(i, a, b, i) for i, a, b in rows], "id bigint, a string, b string, rk bigint")
        got = select.select_balanced(df, "id", "rk", [("a", caps[0]), ("b", caps[1])], target).collect()
        first, more = walk(rows, caps, target)
        assert {r["id"] for r in got if r["pass"] == 1} == first
        assert {r["id"] for r in got if r["pass"] == 2} == more
    rows = [(0, "A", "r1"), (1, "A", "r1"), (2, "A", "r2"), (3, "B", "r1"), (4, "B", "r2")]
    df = spark.createDataFrame([(i, a, b, i) for i, a, b in rows], "id bigint, a string, b string, rk bigint")
    assert {r["id"] for r in select.select_balanced(df, "id", "rk", [("a", 2), ("b", 2)], 3).collect()} == {0, 1, 4}


def test_two_levels(spark):
    rows = [("P", "r1", s, i) for i, s in enumerate((9, 8, 7, 6, 5, 4))] + [("P", "r2", 99, 10)]
    df = spark.createDataFrame(rows, "api string, repo string, score int, ord bigint")
    got = select.two_level_top(df, "api", "repo", [F.col("score").desc(), F.col("ord")], "ord", 5, 20).orderBy("place").collect()
    assert [(r.repo, r.score) for r in got] == [("r1", 9), ("r1", 8), ("r1", 7), ("r1", 6), ("r1", 5), ("r2", 99)]


def test_early_stop(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 16), ("a", 3, 9)], "g string, layer int, gain int")
    assert [r.layer for r in select.early_stop(df, "g", "layer", "gain", 20).orderBy("layer").collect()] == [1, 2]


def test_hash_split_sizes(spark):
    df = spark.createDataFrame([(f"api{i:04d}",) for i in range(850)] * 2, "g string")
    n = {r.split: r["count"] for r in select.hash_split(df, "g", {"train": 0.7, "dev": 0.1, "test": 0.2}, "1").groupBy("split").count().collect()}
    assert n == {"train": 595, "dev": 85, "test": 170}


def test_first_wins_and_numbers(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "ord bigint, k string")
    assert {r.ord for r in dedupe.first_wins(df, [F.col("k")], F.col("ord")).collect()} == {1, 3}
    assert dedupe.duplicate_count(df, [F.col("k")]).first().asDict() == {"total": 4, "kept": 2, "duplicates": 2}
    assert dedupe.first_wins(df.limit(0), [F.col("k")], F.col("ord")).count() == 0
    got = {r.ord: r.seq_id for r in dedupe.numbered(df.repartition(3), [F.col("ord")]).collect()}
    assert got == {1: "SCG-000001", 2: "SCG-000002", 3: "SCG-000003", 4: "SCG-000004"}


def test_greedy_near(spark):
    df = spark.createDataFrame([("g", 1, "abcdefghij"), ("g", 2, "abcdefghiX"), ("g", 3, "abcdeXXXXX"), ("h", 4, "abcdefghij"), ("h", 5, None)], "g string, i bigint, t string")
    assert {r.id for r in dedupe.greedy_near(df, "g", "i", "t").where("kept").collect()} == {1, 3, 4, 5}


def test_prf_and_pass_at_k(spark):
    def prf(p, g):
        arr = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
        return spark.range(1).select(metrics.set_prf(arr(p), arr(g)).alias("m")).first()["m"]

    m = prf(["city", "Units", "units"], ["city", "units", "lang"])
    assert (m.true_positive, round(m.precision, 4), round(m.recall, 4), round(m.f1, 4)) == (2, 0.6667, 0.6667, 0.6667)
    m = prf(["a"], [])
    assert m.precision is None and m.f1 is None and m.pred_count == 1
    for n, c, k, want in ((5, 0, 1, 0), (5, 1, 1, 20), (5, 1, 3, 60), (5, 2, 3, 90), (5, 3, 3, 100), (5, 5, 5, 100)):
        df = spark.createDataFrame([("s", i < c) for i in range(n)], "id string, ok boolean")
        assert metrics.pass_at_k(df, "id", "ok", [k]).first().pass_at_k == want


def test_wilson(spark):
    for c, n, low, high in ((95, 114, 0.7543, 0.8906), (16, 19, 0.6243, 0.9448), (2, 4, 0.15, 0.85)):
        a, b = metrics.wilson(F.lit(float(c)), F.lit(float(n)))
        r = spark.range(1).select(F.round(a, 4).alias("a"), F.round(b, 4).alias("b")).first()
        assert (r.a, r.b) == (low, high)


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id bigint, embedding array<float>").repartition(3)
    want = {i: [int(x) for x in np.lexsort((np.arange(60), -np.round(v[i].astype(float) @ v.T.astype(float), 9)))[:4]] for i in range(60)}
    for block in (4096, 7):
        got = {}
        for r in metrics.nearest(df, df, 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.corpus_id)
        assert got == want


def test_record_findings(spark):
    body = "a1B2c3D4e5F6g7H8i9J0k"
    tokens = {
        "github_token": "ghp_" + body, "github_pat": "github_pat_" + body, "openai_style_key": "sk-proj-" + body, "slack_token": "xoxb-" + body, "aws_access_key": "ASIA" + "A1" * 8,
        "google_api_key": "AIza" + "a1B_c" * 7, "huggingface_token": "hf_" + body, "jwt": "eyJ" + "a1" * 6 + "." + "b2" * 6 + "." + "c3" * 6, "private_key": "-----BEGIN RSA PRIVATE KEY-----",
        "azure_storage_key": "aB" * 43 + "==", "gitlab_pat": "glpat-" + body, "google_oauth_secret": "GOCSPX-" + body, "stripe_key": "rk_live_" + body, "sendgrid_key": "SG." + body + "." + body,
        "telegram_bot_token": "12345678:" + "aB" * 16, "email": "mail some.one@site.org now", "absolute_user_path": "open('/home/someone/x')", "authorization_literal": "Bearer " + body,
        "unredacted_api_key": f'API_KEY = "{body}"', "query_appid": f"/x?appid={body}",
    }
    for kind, t in tokens.items():
        assert audit.audit_text(t) == {kind}, kind
    for t in ('token = "YOUR_TOKEN"', "Bearer ${TOKEN_VALUE}", 'key = "aaaaaaaa"', "ghp_short", "C:/Users/<REDACTED_USER>/x"):
        assert audit.audit_text(t) == set(), t
    rows = [(1, "clean", (f'[{{"name": "token", "deep": {{"secret": "{body}"}}}}]', "/home/someone"), {"X-RapidAPI-Key": body}), (2, None, (None, "https://h/home/x"), None), (3, tokens["sendgrid_key"], ("bare", ""), {})]
    df = spark.createDataFrame(rows, "ord int, code string, meta struct<params: string, file_url: string>, headers map<string, string>")
    got = {tuple(r) for r in audit.record_findings(df, "ord", ["meta.params"]).collect()}
    assert got == {(1, "meta.params:[0].deep.secret", "sensitive_json_field"), (1, "headers.X-RapidAPI-Key", "sensitive_json_field"), (3, "code", "sendgrid_key")}


def test_greedy_near_as_walked(spark):
    rng = random.Random(7)
    words = [f"{a}{b}_{c}" for a in ("get", "list", "put") for b in ("City", "rate", "x9") for c in ("id", "name", "é")]
    base = [" ".join(rng.choice(words) + rng.choice(" =(.,;") for _ in range(n)) for n in (3, 12, 30, 60, 60)] + ["ab" * 150]
    rows = [(None, 0, ""), (None, 1, None), ("", 2, "x"), ("", 3, "x")]
    for i in range(4, 64):
        t = list(rng.choice(base))
        for _ in range(int(len(t) * rng.choice((0, 0.02, 0.08, 0.15)))):
            t[rng.randrange(len(t))] = rng.choice("qzeta_(")
        rows.append((rng.choice(("g", "g", "h")), i, "".join(t)))
    kept, want = {}, set()
    for g, i, t in rows:
        seen, t = kept.setdefault(g or "", []), t or ""
        if not any(difflib.SequenceMatcher(None, t, k).ratio() > 0.85 for k in seen):
            seen.append(t)
            want.add(i)
    df = spark.createDataFrame(rows, "g string, i bigint, t string").repartition(3)
    assert 10 < len(want) < 60
    for block in (1000, 4):
        got = dedupe.greedy_near(df, "g", "i", "t", block=block).collect()
        assert sorted(r.id for r in got) == list(range(64)) and {r.id for r in got if r.kept} == want


def _codes(texts):
    place = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
    return [np.array([place[c] for c in t], np.int64) for t in texts]


def _edited(rng, text, n, letters):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t) + 1)
        gone, come = rng.choice(((1, 1), (0, 2), (1, 0), (9, 0)))
        t[at : at + gone] = rng.choices(letters, k=come)
    return "".join(t)


def test_matcher_decides_as_sequence_matcher(monkeypatch):
    rng = random.Random(3)
    for points in (dedupe._Matcher.POINTS, 50):
        monkeypatch.setattr(dedupe._Matcher, "POINTS", points)
        for _ in range(600):
            letters = rng.choice(("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz_ (){}é😀"))
            b = "".join(rng.choice(letters) if rng.random() < 0.7 else letters[0] for _ in range(rng.choice((0, 1, 7, 50, 199, 200, 201, 500))))
            a = _edited(rng, b, rng.choice((0, 1, 5, 20, 80)), letters)
            ratio, (ca, cb) = difflib.SequenceMatcher(None, a, b).ratio(), _codes([a, b])
            for threshold in (0.85, 0.5, ratio, ratio - 1e-9):
                assert dedupe._Matcher(b, cb).exceeds(a, ca, threshold) == (ratio > threshold)


def test_near_pairs_of_unrelated_texts_are_spared_the_ratio(monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    lines = ("    {0}_{1} = {2}.get('{3}', {{}})", "    if not {0}:\n        return {1}({2}, '{3}')", "    logger.info('{0} {1}', {2}_{3})", "    for {0} in {1}:\n        {2}.append({3})")
    texts = []
    for k in range(90):
        fresh = "import requests\n\n" + "\n".join(rng.choice(lines).format(*rng.choices(words, k=4)) for _ in range(22))
        texts.append(_edited(rng, rng.choice(texts), rng.choice((3, 30)), "qzeta_(") if k % 5 == 4 else fresh)
    rows, codes, own = [("g", i, t) for i, t in enumerate(texts)], _codes(texts), list(range(len(texts)))
    near = {(x, y) for y in own for x in range(y) if difflib.SequenceMatcher(None, texts[y], texts[x]).ratio() > 0.85}
    kept: list[int] = []
    for y in own:
        if not any((x, y) in near for x in kept):
            kept.append(y)
    assert len(near) >= 10
    for by_gram_from in (1024, 8):
        monkeypatch.setattr(dedupe, "_ROWS", by_gram_from)
        found = set(dedupe._candidates(rows, codes, own, own, 0.85))
        assert near <= found and len(found) <= 40  # of 4,005 pairs
        # Whole groups are settled; of blocks, all near pairs come out, each once.
        unit = {"grp": ["g"] * len(texts), "id": own, "text": texts}
        settled = dedupe._similar(0.85)(pa.table(unit | {k: pa.array([-1] * len(texts), pa.int32()) for k in ("block", "p", "q")}))
        assert set(own) - set(settled["later"].to_pylist()) == set(kept) and settled["earlier"].null_count == settled.num_rows
        block = [i % 2 for i in own]
        got = []
        for p, q in ((0, 0), (0, 1), (1, 1)):
            part = pa.table(unit | {"block": block, "p": [p] * len(texts), "q": [q] * len(texts)}).filter(pa.array([k in (p, q) for k in block]))
            t = dedupe._similar(0.85)(part)
            got += zip(t["earlier"].to_pylist(), t["later"].to_pylist())
        assert len(got) == len(set(got)) and set(got) == near
    # Long texts of the same words: nearly all of these 3,160 pairs once went on to the comparison in sequence.
    texts = ["\n".join(rng.choice(lines).format(*rng.choices(words, k=4)) for _ in range(110)) for _ in range(80)]
    assert not list(dedupe._candidates([("g", i, t) for i, t in enumerate(texts)], _codes(texts), range(80), range(80), 0.85))


def test_near_duplicates_of_an_api_across_repositories(spark, monkeypatch):
    from millrace.plans import records

    rows = [(1, "weather", "a/one", "def f(): return 1"), (2, "weather", "b/two", "def f(): return 1"), (3, "other", "a/one", "def f(): return 1"), (4, "weather", None, "x = 5")]
    monkeypatch.setattr(records, "flat", lambda s, d: s.createDataFrame(rows, "ord bigint, api_name string, repo string, code string"))
    assert {r.id: r.kept for r in records.near_dup_greedy(spark, "").collect()} == {1: True, 2: False, 3: True, 4: True}


SIDE_ROWS = [
    (1, '{"a": 1}', '{"ticket": "string"}', '[{"name": "trace"}]', '{"body_id": {"deep": 2}}', None), (2, None, None, None, '{"only": ["x"]}', '"bare"'), (3, None, None, None, None, None),
]
SIDE_TYPE = "ord bigint, params string, path_params string, header_params string, payload string, code_params string"


def test_documented_params_of_all_fields(spark, monkeypatch):
    from millrace.plans import apis

    rows = [(*r, "documentation") for r in SIDE_ROWS] + [(4, '{"a": 1}', None, None, None, None, "code"), (5, '["one", "two words", {"name": "p", "schema": {"s": 1}, "other": {"z": 1}}]', None, None, '"bare.name"', None, None)]
    monkeypatch.setattr(apis, "flat", lambda s, d: s.createDataFrame(rows, SIDE_TYPE + ", params_source string"))
    got = {r.ord: (r.flat_names, r.all_names) for r in apis.documented_params(spark, "").collect()}
    assert got[1] == (["a", "body_id", "deep", "ticket", "trace"], ["a", "body_id", "deep", "ticket", "trace"])
    assert got[2] == (["only", "x"], ["only"]) and got[3] == ([], [])
    # Parameters read from code are no documentation; of a list, names, schemas and plain names count.
    assert got[4] == (["a"], []) and got[5] == (["bare.name", "one", "p", "s"], [])


def test_json_walk_of_all_fields(spark, monkeypatch):
    from millrace.plans import apis

    monkeypatch.setattr(apis, "flat", lambda s, d: s.createDataFrame(SIDE_ROWS, SIDE_TYPE))
    got = {tuple(r) for r in apis.json_walk(spark, "").collect()}
    assert got == {(1, "path_params.ticket", "ticket", "string"), (1, "header_params[0].name", "name", "trace"), (2, "payload.only[0]", "only", "x"), (2, "code_params", "code_params", "bare")}


def test_documentation_coverage(spark, monkeypatch):
    from millrace.plans import records

    names = "ord api_name api_host code url route method endpoint_id match params params_source path_params header_params payload".split()
    rows = [
        (1, "a", "h", "get(ticket)", "https://h/x", None, "GET", None, "url", '"q"', "observed", '{"ticket": 1}', None, None), (2, "a", "h", "none", "https://h/x", "/x", None, "", "route", None, None, None, None, '{"body_id": 1}'),
        (3, "a", "h", "city", None, "/y", "GET", "", "route", '[{"name": "city", "type": "string"}]', "documented", None, "{}", ""), (4, None, "h", "string", None, None, None, None, "host_only", '["z"]', "observed", None, None, None),
        (5, "a", None, "call('/deep')", "https://k/deep", None, "GET", "e", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'ord' else 'string'}" for c in names)).withColumn("headers", F.create_map(F.lit("k"), F.lit("v")))
    monkeypatch.setattr(records, "heavy", lambda s, d, *c: df)
    r = records.documentation_coverage(spark, "").first()
    assert (r.n, r.metadata_complete, r.endpoint_matched, r.host_only, r.no_match, r.endpoints) == (5, 2, 4, 1, 0, 3)
    assert (r.with_params, r.param_documented, r.param_used, r.used_share) == (4, 3, 2, 66.67)


def test_balanced_selection_with_keys(spark):
    rows = [(0, "A", "r1", "k0"), (1, "A", "r1", "k1"), (2, "A", "r1", "k0"), (3, "A", "r1", "k2"), (4, "A", "r1", "k2"), (5, None, "r2", "k3")]
    df = spark.createDataFrame([(i, a, b, k, i) for i, a, b, k in rows], "id bigint, a string, b string, k string, rk bigint")
    got = {(r["id"], r["pass"]) for r in select.select_balanced(df, "id", "rk", [("a", 2), ("b", 9)], 10, key="k").collect()}
    assert got == {(0, 1), (1, 1), (5, 1), (3, 2)}
    assert {r["id"] for r in select.select_balanced(df, "id", "rk", [("a", 2), ("b", 9)], 4, key="k").collect()} == {0, 1, 5, 3}
    assert select.select_balanced(df.limit(0), "id", "rk", [("a", 2)], 4).count() == 0


def test_join_without_hot_keys(spark):
    from millrace.operators.joins import join_hot

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x") for i in range(60)] + [(99, None, "x")], "id bigint, k string, other string")
    keys = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, v int")
    for how, n in (("inner", 41), ("left", 61)):
        ways = [join_hot(rows, keys, ["k"], how, bound=b, hot=h) for b, h in ((10, 5), (0, 5), (None, 5), (None, 10**6))]
        got = [sorted(map(tuple, w.collect()), key=str) for w in ways]
        assert len(got[0]) == n and all(g == got[0] for g in got)
