import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symdex.functions import queries as Q
from symdex.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("name, parts", [("HTTPServer", ["HTTP", "Server"]), ("getUserName", ["get", "User", "Name"]), ("plain", ["plain"]), ("", [])])
def test_camel(spark, name, parts):
    assert one(spark, name, X.camel_parts) == parts


def test_identifiers_and_terms(spark):
    assert one(spark, "loadHTTPData x plain parse_fileName", X.split_identifiers) == "load HTTP Data file Name"
    assert one(spark, "getUser_name GetUser", X.terms) == ["getuser", "get", "user", "name"]
    assert one(spark, "检索引擎 a", X.terms) == ["a", "检索", "索引", "引擎"]
    assert one(spark, "检 カナ 한글", X.cjk_bigrams) == ["检"]


def test_columns_agree_with_driver(spark):
    texts = ["parseHTTPServer_index", "检索引擎x", "a1B2 c_d__e", "", "é_x café", "XMLHttp2Request"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r["t"] for r in df.select(X.terms(F.col("c")).alias("t")).collect()]
    assert got == [Q.query_terms(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aBc1_ 检索é.", max_size=20))
def test_driver_terms_are_distinct_and_lower(text):
    t = Q.query_terms(text)
    assert len(t) == len(set(t)) and all(x == x.lower() and x for x in t)


@pytest.mark.parametrize("pattern, path, hit", [("src/**/*.py", "src/a.py", True), ("src/**/*.py", "src/sub/b.py", True), ("*.py", "a/b.py", True), ("a?.py", "ab.py", True), ("[ab].py", "c.py", False), ("A.py", "a.py", False), ("x.py", "xxpy", False)])
def test_glob(pattern, path, hit):
    assert bool(re.match(X.glob_regex(pattern), path)) is hit


def test_names_and_estimates(spark):
    assert one(spark, "src/pkg/a.py", X.module_name) == "pkg.a"
    assert one(spark, "a/b/__init__.py", X.module_name) == "a.b.__init__"
    assert one(spark, "../near/x.ts", X.import_candidate) == "x"
    assert one(spark, "os.path", X.import_candidate) == "os.path"
    assert one(spark, "abcd" * 10, X.token_estimate) == 10
    assert one(spark, "检索", X.token_estimate) == 3
    assert one(spark, "", X.token_estimate) == 1
    assert one(spark, "a/b.tsx", X.language_of) == "typescript"
    assert one(spark, "a/b.PY", X.language_of) is None
    assert one(spark, "a-b, c_d!", X.sanitize_phrase) == "a b c_d"


def test_query_parser():
    assert Q.parse_query('"read file" loadUser') == [["read", "file"], ["loaduser"], ["load"], ["user"]]
    assert Q.parse_query('"检索引擎"') == [["检索", "索引", "引擎"]]
    assert Q.parse_query("  ") == []


def test_expansion(tmp_path):
    assert Q.expand_query("load") == "load get fetch retrieve"
    assert Q.expand_query("zzz") == "zzz"
    trace = []
    assert Q.expand_query("auth x", {"auth": ["sso", "oidc", "saml", "ldap", "krb"]}, trace=trace) == "auth x sso oidc saml ldap krb"
    assert trace == [{"term": "auth", "layer": "custom", "synonyms": ["sso", "oidc", "saml", "ldap", "krb"]}]
    (tmp_path / "s.json").write_text('{"a": ["b"], "c": "d", "e": ["f", 1]}')
    assert Q.load_synonyms(tmp_path / "s.json") == {"a": ["b"]}
    assert Q.load_synonyms(tmp_path / "none.json") is None
    assert len(Q.CLUSTERS.strip().splitlines()) == 34


@pytest.mark.parametrize("strategy, size", [("none", (0, 0)), ("Generous", (10, 10)), ("3,-1", (3, -1)), ("what", (5, 5))])
def test_window(strategy, size):
    assert Q.window(strategy) == size
