import pytest

from symdex.llm import docpairs as D


@pytest.mark.parametrize(
    "content, doc",
    [
        ('def f(a: int = (1), b="):") -> str:\n    """Says it."""\n    return 1\n', "Says it."),
        ("@x('def g():')\nasync def f(): 'one line'\n", "one line"),
        ('def f():\n    # note\n    r"raw"\n', "raw"),
        ('def f():\n    x = "no"\n', None),
        ('def f():\n    "a" + b\n', None),
        ('def f():\n    f"no"\n', None),
        ("def f(", None),
    ],
)
def test_docstring(content, doc):
    assert D.docstring(content) == doc


def test_links():
    go = ["package a", "", "// Runs all of it now.", "func Run() {", "}", "// far away comment", "", "func B() {", "}", "/* no doc */", "func C() {", "}"]
    assert D.link(go, "go", [(4, "Run", None), (8, "B", None), (11, "C", None)]) == ["Runs all of it now.", None, None]
    rust = ["/// Says a thing.", "#[inline]", "#[cfg(", "    x", ")]", "pub fn a() {}", "// plain", "fn b() {}", "/** Block doc */", "fn c() {}"]
    assert D.link(rust, "rust", [(6, "a", None), (8, "b", None), (10, "c", None)]) == ["Says a thing.", None, "Block doc"]
    js = ["/**", " * Adds x.", " * @param x the x", " */", "function a(x) {}", "// line", "function b() {}", "/* plain */", "function c() {}"]
    assert D.link(js, "other", [(5, "a", "a(x)"), (7, "b", ""), (9, "c", None)]) == ["\nAdds x.\n@param x the x\n", None, None]


def test_functions_of_one_line_share_the_comment():
    js = ["/** Turns left and right. */", "const left = () => 1, right = () => 2;", "/** Far from all of them. */", "", "function stop() {}"]
    assert D.link(js, "other", [(2, "left", None), (2, "right", None), (5, "stop", None)]) == ["Turns left and right.", "Turns left and right.", None]


def test_tags_names_and_distance_decide_contested_comments():
    js = ["/** Adds up the total. @param a one */", "/** Takes it away again. @param b two */", "function add(a) {} function sub(b) {}"]
    assert D.link(js, "other", [(3, "add", "add(a)"), (3, "sub", "sub(b)")]) == ["Adds up the total. @param a one", "Takes it away again. @param b two"]
    assert D.link(js, "other", [(3, "sub", "sub(b)"), (3, "add", "add(a)")]) == ["Takes it away again. @param b two", "Adds up the total. @param a one"]
    assert D.link(js, "other", [(3, "sub", "sub(b)")]) == ["Takes it away again. @param b two"]  # the nearest of a stack
    assert D.link(js, "other", [(3, "add", "add(a)")]) == ["Adds up the total. @param a one"]  # tags of other parameters outweigh a step
    named = ["/** What start does here. */", "/** What halt does here. */", "const halt = () => 1, start = () => 2"]
    assert D.link(named, "other", [(3, "halt", None), (3, "start", None)]) == ["What halt does here.", "What start does here."]
    assert D.link(["/** Far off. */", "/* no doc */", "f()"], "other", [(3, "f", None)]) == [None]


def test_long_attributes():
    rust = ["/// Says a thing.", "#[derive("] + [f"    A{i}," for i in range(40)] + [")]", "fn a() {}"]
    assert D.link(rust, "rust", [(len(rust), "a", None)]) == ["Says a thing."]


def test_assignment_prefers_the_cheapest_whole():
    assert D.assign([{0: 1.0, 1: 2.0}, {0: 1.5}, {}]) == [1, 0, None]


@pytest.mark.parametrize(
    "said, name, bare",
    [
        ("Adds two numbers together.", "add", False), ("Add.", "add", True), ("The load user file function.", "loadUserFile", True), ("LoadUserFile", "load_user_file", True), ("TODO: write the documentation for this", "f", True),
        ("TODO aside, this blocks until it has been written.", "f", False), ("Description goes here, to be written later.", "f", True), ("Auto-generated method stub", "f", True), ("todo(docs): add a description here please", "f", True),
        ("No documentation available for this function yet.", "f", True), ("检查路线与窗口是否一致", "f", False), ("待补充", "f", True), ("", "f", True), ("====", "f", True), ("Documentation is loaded from disk and cached.", "f", False),
    ],
)
def test_trivial(said, name, bare):
    assert D.trivial(D.description(said), name) is bare


def test_description_leaves_entries_out():
    assert D.description("Reads it all.\n\nArgs:\n    a: the first\n    b: the second\nReturns:\n    x\n") == "Reads it all."
    assert D.description("Reads.\n\nParameters\n----------\na : int\n    the a\n") == "Reads."
    assert D.description(":param a: the a\n:return: b") == ""
    assert D.description("Sums up.\n@param a the a\n@return b").strip() == "Sums up."
    assert D.description("Opens it.\n\n# Errors\nFails when gone.") == "Opens it."


def test_table(spark):
    py = 'def f(a):\n    """Counts all the words in it."""\n    return a\n'
    chunks = [("p.py::f", "p.py", "function", "f", 1, "def f(a):", py), ("p.py::f", "p.py", "function", "f", 1, "def f(a):", py), ("g.go::A", "g.go", "function", "A", 4, None, "func A() {}"), ("g.go::N", "g.go", "method", "N", None, None, "func N() {}"), ("p.py::C", "p.py", "class", "C", 1, "class C:", py), ("q.py::n", "q.py", "function", "n", 1, None, None), (None, "q.py", "function", "n", 1, None, py), ("x.rs::z", "x.rs", "function", "z", 2, None, "fn z() {}")]
    c = spark.createDataFrame([(*r, 1, "t") for r in chunks], "chunk_id string, file_path string, chunk_type string, symbol string, start_line int, signature string, content string, x int, text string")
    go = "package a\r\n\r\n// Starts the whole engine up.\r\nfunc A() {}\r\n"
    f = spark.createDataFrame([("g.go", go, "s"), ("g.go", go, "s"), ("x.rs", None, "s"), (None, "// a", "s")], "file_path string, content string, suffix string")
    rows = {r["chunk_id"]: r for r in D.pairs(c, f).collect()}
    assert set(rows) == {"p.py::f", "g.go::A"} and rows["g.go::A"]["description"] == "Starts the whole engine up." and rows["g.go::A"]["code"] == "func A() {}"
    assert D.found(c, f).count() == 2 and D.found(c.limit(0), f).count() == 0
