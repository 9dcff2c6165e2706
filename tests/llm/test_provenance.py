import textwrap

import pytest

from symdex.llm import provenance as P

A = P._automaton()


@pytest.mark.parametrize(
    "text, hit",
    [
        ("// Code generated by protoc-gen-go. DO NOT EDIT.\npackage a", True),
        ("/*\n * Licence\n *\n * @generated by x from y\n */\nclass A {}", True),
        ("# <auto-generated>\n# </auto-generated>\nx = 1", True),
        ('"""This file was automatically created by tool."""\n', True),
        ("// AUTOGENERATED FILE - manual changes are overwritten\n", True),
        ("# Do not modify: produced from a.idl\n", True),
        ("// !! machine written, hand edits vanish at the next run !!\n", True),
        ("// Not generated: feel free to edit\npackage a", False),
        ("// auto-generated names are accepted, see the note\n", False),
        ("// Writes the DO NOT EDIT banner into every file.\n", False),
        ("// The @generated mark is looked for below.\n", False),
        ("# Code generated by older releases is read here and checked by hand-written rules.\n", False),
        ("x = 1\n# Code generated by x. DO NOT EDIT.\n", False),
        ("", False),
    ],
)
def test_notices(text, hit):
    assert (P.notice(text, A) is not None) is hit


@pytest.mark.parametrize("path, hit", [("r/node_modules/a/b.js", True), ("r/vendor/a/b.go", True), ("r/vendor_portal/a.py", False), ("r/vendorapi/a.go", False), ("r/src/_vendored/x/a.rs", True), ("r/external_api/a.rs", False), ("r/a.min.js", True), ("r/a_pb2.py", True), ("r/minifier/a.js", False), ("r/contrib/x-2.4.1/a.go", True), ("r/Cargo.lock", True)])
def test_paths(path, hit):
    assert bool(P.VENDORED.search(path) or P.VERSIONED.search(path) or P.WRITTEN.search(path)) is hit


def code(n, names):
    return "".join(f"def {names}{i}(a, b):\n    # adds {names} to {i}\n    c = a.{names}_{i} + b[{i}]\n    if c > {i}:\n        return {names}(c, {i})\n    for x in c:\n        print(x, '{names}')\n    return a\n\n\n" for i in range(n))


def test_makeup():
    assert P.makeup("!function(a){return a.b?a.c(1):{d:2}}(this);var x=function(e){for(var i=0;i<e.length;i++)e[i].f=3;return e};" * 4) == "minified"
    assert P.makeup("T = [\n" + "    1.5, 2.5, 3.5,\n" * 60 + "]\n") in ("data", "repetitive")
    assert P.makeup('K = "' + "QUJD" * 300 + '"\n') == "data"
    assert P.makeup("def f(s, c):\n" + "".join(f"    if s == {i} and c == {i * 7}:\n        s = {i + 1}\n" for i in range(40))) == "repetitive"
    assert P.makeup("{\n" + '  "a": {"b": 1, "c": [0, 1]},\n' * 40 + "}\n") is None and P.makeup("a:\n" + "  - b: c of d\n" * 40) is None
    assert P.makeup("import os\n\n\n" + 'X = [1, 2]\n\n\ndef f(a):\n    return os.path.join(a, "b")\n') is None


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_table(spark, monkeypatch, bound):
    monkeypatch.setattr(P, "BROADCAST_RUNS", bound)
    upstream = spark.createDataFrame([(1, "pkg", "1.0", code(12, "alpha")), (2, "other", None, None)], "upstream_id int, package string, version string, content string")
    mine = code(2, "beta").replace("return a", "return beta.run(a)") + "class K:\n    pass\n"
    rows = [(1, "r/a.py", code(12, "alpha").replace("alpha_3", "renamed")), (1, "r/a.py", code(12, "alpha").replace("alpha_3", "renamed")), (2, "r/b.py", mine), (3, "r/c.py", None), (4, "r/d.py", "  \n"), (5, "r/vendor/x/e.py", mine), (6, None, "# @generated\n")]
    files = spark.createDataFrame([(*r, "x", 1) for r in rows], "file_id long, file_path string, content string, kind string, n int")
    got = {r["file_id"]: r["kind"] for r in P.evidence(files, upstream).collect()}
    assert got == {1: "copy", 5: "path", 6: "generated"} and P.evidence(files, upstream).count() == 3
    assert P.evidence(files, upstream.limit(0)).count() == 2 and P.evidence(files.limit(0), upstream).count() == 0


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_rewrapped_copies(spark, monkeypatch, bound):
    monkeypatch.setattr(P, "BROADCAST_RUNS", bound)
    text = code(12, "alpha")
    wrapped = "\n".join(textwrap.wrap(" ".join(text.split()), 61))
    assert not {x.strip() for x in wrapped.split("\n")} & {x.strip() for x in text.split("\n")} and P.makeup(wrapped) is None
    files = spark.createDataFrame([(1, "r/a.py", wrapped)], "file_id long, file_path string, content string")
    upstream = spark.createDataFrame([(1, "pkg", "1.0", text)], "upstream_id int, package string, version string, content string")
    assert [r["kind"] for r in P.evidence(files, upstream).collect()] == ["copy"]
