"""Known values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import code as cd
from millrace.functions import identity, jsonvals, text, urls
from millrace.operators import audit, quality


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("x,y", [(None, ""), ("", ""), ("a/b", "/a/b"), ("https://h.com", "/"), ("https://h.com/x?y=1", "/x"), ("/x?y=1", "/x")])
def test_route(spark, x, y):
    assert one(spark, urls.route(F.lit(x).cast("string"))) == y


@pytest.mark.parametrize("x,y", [("", "/"), ("a?b=1", "/a"), ("/x", "/x")])
def test_flat_route(spark, x, y):
    assert one(spark, urls.flat_route(F.lit(x))) == y


@pytest.mark.parametrize("x,y", [("/a", ["/a", "/a/"]), ("/a/", ["/a/", "/a"]), ("/", [])])
def test_route_variants(spark, x, y):
    assert one(spark, urls.route_variants(F.lit(x))) == y


def test_names(spark):
    assert one(spark, urls.method(F.lit(None).cast("string"))) == "GET"
    assert one(spark, urls.method(F.lit(" post "))) == "POST"
    assert one(spark, text.words(F.lit("getUser_info-v2"))) == "get User info v2"
    assert one(spark, text.snake(F.lit("getUserInfo v2!"))) == "get_user_info_v2"
    assert one(spark, text.stable_id(F.lit("weather"), F.lit("GET"), F.lit("/v1/now"))) == "50a3a1fb9022963c"
    assert one(spark, text.code_hash(F.lit("def f():  \n    return 1 \n"))) == "fe0d1b7d1a8d8d33057e3a0db3614e88ddebf041"
    assert one(spark, text.ordered_distinct(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b")))) == ["b", "a"]
    assert one(spark, text.lines(F.lit("a\r\nb\rc\n"))) == ["a", "b", "c"]


@pytest.mark.parametrize("x,y", [("aabb", 1.0), ("abcdefgh", 3.0), ("aaaaaaaa", 0.0), ("", 0.0)])
def test_entropy(spark, x, y):
    assert one(spark, text.entropy(F.lit(x))) == pytest.approx(y)


def test_safe_values(spark):
    for v, want in [("abc12", True), ("YOUR_API_KEY", True), ("xxxxxx", True), ("a1B2c3D4e5F6", False)]:
        assert one(spark, audit.safe_literal(F.lit(v))) is want
    assert one(spark, audit.sensitive(F.lit("token"), F.lit("Bearer a1B2c3D4e5F6"))) is True
    assert one(spark, audit.sensitive(F.lit("key"), F.lit("aaaaaaaa"))) is False


def test_score(spark):
    def score(**k):
        base = dict.fromkeys(("valid", "call", "response", "error", "docstring", "imports", "database", "indentation"), False) | {"loc": 5, "stars": 0, "n_comments": 0} | k
        return one(spark, quality.quality_score(**{a: F.lit(b) for a, b in base.items()}))

    assert score(valid=True, call=True, response=True, error=True, loc=35, n_comments=3, imports=True) == 100
    assert score(valid=True, call=True) == 45
    assert one(spark, quality.comment_score(F.lit(10), F.lit(True))) == 25


def test_fence(spark):
    a = "```python\na\n``` and\n```\nlonger code\n```"
    assert one(spark, text.fence(F.lit(a))) == "longer code"
    assert one(spark, text.fence(F.lit(" bare "))) == "bare"
    assert one(spark, text.fence(F.lit(None).cast("string"))) == ""


def test_hosts_and_repositories(spark):
    for x, y in [("HTTP://A.b.Example/", "a.b.example"), ("a.example:443", "a.example"), (" a.example.", "a.example"), ("https://u:p@a.example:8/x?y", "a.example"), ("  ", None), ("", None), ("https://", None), (":443", None), (None, None)]:
        assert one(spark, identity.host_name(F.lit(x).cast("string"))) == y
    for x, y in [("https://site.example/Own/Name.git", "own/name"), ("git@site.example:Own/Name.git", "own/name"), (" Own/Name/ ", "own/name"), ("https://site.example/own/name/tree/main", "own/name"), ("own/na.me", "own/na.me"), ("", None), (" \t", None), ("/", None), (" own / name ", "own / name"), (None, None)]:
        assert one(spark, identity.repo_name(F.lit(x).cast("string"))) == y


def test_query_map(spark):
    assert one(spark, urls.query_map(F.lit("https://h/x?a=1&b=2&a=3&c"))) == {"b": "2", "a": "3", "c": ""}
    assert one(spark, urls.fill_placeholders(F.lit("/a/{id}/<x>/:y"), F.create_map(F.lit("id"), F.lit("7")))) == "/a/7/test/test"


def test_json():
    assert jsonvals.names('[{"name": "city"}, {"key": "units", "schema": {"deep": 1}}]', '{"Authorization": "x", "lang": {"inner": 1}}') == ["city", "deep", "inner", "lang", "units"]
    assert jsonvals.names('"a,b;c"', None, "not json {", '"a.b"') == ["a.b"]  # whole names alone
    assert jsonvals.walk('{"a": ["token"], "b": {"c": "x"}}') == [("a[0]", "a", "token"), ("b.c", "c", "x")]
    assert jsonvals.walk('{"a": ["token"]}', compat=True) == []
    assert jsonvals.balanced('x = {"a": "}"} y = [1, {"b": 2}] z = {') == ['{"a": "}"}', '[1, {"b": 2}]']


def test_comments(spark):
    for x, y in [('[{"text": "a"}, {"text": " b "}]', "a\n\nb"), ('["a", ""]', "a"), ('"a"', "a"), ("bare text", "bare text"), (None, "")]:
        assert one(spark, jsonvals.comments_text(F.lit(x).cast("string"))) == y


def test_code_facts():
    src = 'import requests\n\ndef f(city):\n    """First line.\n    More."""\n    params = {"q": city}  # note\n    url = "https://h.example/x"\n    return requests.get(url, params=params)\n'
    valid, has_doc, doc, names, notes, returns, clients, params, method, url = cd.facts(src)
    assert (valid, has_doc, doc, names, notes, returns, clients, params, method, url) == (True, True, "First line.", ["f"], 1, True, ["requests"], ["q"], "GET", "https://h.example/x")
    assert cd.facts("def broken(:")[0] is False and cd.facts(None)[0] is False
    assert [x[0] for x in cd.extract(src, ["h.example"])] == ["f"] and cd.extract(src, ["other"]) == []
    code, used = cd.annotate(src)
    assert used == ["Build the query parameters sent to the endpoint.", "Define the target RapidAPI endpoint URL."] and code.count("    # ") == 2 and "More." in code
    assert cd.annotate("") == ("", [])
    assert cd.annotate("async def f(a,\n    b):\n\n    x = 1\n    return x") == ("async def f(a,\n    b):\n\n    x = 1\n    return x", [])
    assert cd.annotate("def f():\n\n    x = 1\n    return x") == ("def f():\n\n    # Invoke the service API and return the processed result.\n    x = 1\n    return x", [cd.FALLBACK])
    assert cd.annotate("# note\ndata = 1\ndata = 2")[1] == ["Prepare the request payload for the API call."]
    module = "import os\nfrom a import (\n    b,\n)\n\ndef f():\n    import late\n    return 'h'\n"
    assert cd.extract(module, [])[0] == ("f", 6, "def f():\n    import late\n    return 'h'", "import os\nfrom a import (", "import os\n\nfrom a import (\n\ndef f():\n    import late\n    return 'h'")
    assert cd.facts("q: dict = {'a': 1, 'Accept': 2}\nhttpx.get(u, params=q)")[6:8] == (["httpx"], ["a"])
    assert cd.facts("x = y = {'b': 1}\nprint({'c': 1})")[7] == ["b", "c"] and cd.facts("payload = y = {'b': 1}\nz = {'c': 1}")[7] == ["b"]
    assert cd.facts("def broken(: requests.get({'k': 1, 'accept': 2})")[6:8] == (["requests"], ["k"])
