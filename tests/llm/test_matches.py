from codelode.llm import parsing


def names(text, language):
    return [n for n, _, _, _ in parsing.functions(text, language)[1]]


def test_functions_that_the_parser_matches():
    go = "// A says.\nfunc A() {\n}\n\n// B counts all of the rows it gets.\nfunc (t *T) B(x int) error {\n\treturn nil\n}\n"
    assert [(n, c.strip("/ ")) for n, c, _, _ in parsing.functions(go, "go")[1]] == [("A", "A says."), ("B", "B counts all of the rows it gets.")]
    ts = "interface S {\n  // Opens the store for all.\n  open(a: string): void;\n  size: number;\n}\nexport const twice = (a: number): number => a * 2;\nclass K { run = async (x) => { go(x); }; #p(b?: T): void {} }\n"
    found = parsing.functions(ts, "typescript")[1]
    assert [n for n, *_ in found] == ["open", "twice", "run", "p"] and [ts[a:b] for n, _, a, b in found if n == "twice"] == ["twice = (a: number): number => a * 2"]
    java = "/** Reads it. */\n@A(\n  x = {1,\n  2}\n)\npublic int f(int a) { return a; }\ninterface I {\n  /** Says so. */\n  void g();\n}\n"
    assert [(n, c.strip()[4:-3]) for n, c, _, _ in parsing.functions(java, "java")[1]] == [("f", "Reads it."), ("g", "Says so.")]
    assert names("impl A {\n    /// Makes one.\n    pub fn new() -> A { A {} }\n}\n", "rust") == ["new"]
    assert names("/* Opens it. */\nint open_it(const char *p);\ntypedef int (*cb)(int);\nint x = f(3);\n", "c") == ["open_it"]


def test_docstrings_are_first_statements():
    py = "@d\nclass A:\n    @p(1)\n    async def f(self):\n        r'''Doc of f.'''\n\n    def g(self): 'one'; return 1\n\n    def h(self):\n        # it's\n        return \"isn't\"\n"
    ok, found = parsing.functions(py, "python")
    assert ok and [(n, c) for n, c, _, _ in found] == [("f", "Doc of f."), ("g", "one"), ("h", "")]
    assert py[found[0][2] :].startswith("@p(1)") and py[: found[0][3]].endswith("Doc of f.'''")


def test_whole_functions_of_broken_chunks():
    py = "class A:\n    def a(self):\n        return 1\n\n    def b(self):\n<<<<<<< ours\n        return 2\n=======\n        return 3\n>>>>>>> theirs\n\n    def c(self):\n        return 4\n"
    assert not parsing.valid(py, "python") and names(py, "python") == ["a", "c"]
    java = "class A {\n  int a() { return 1; }\n  int b( { return 2; }\n  int c() { return 3; }\n}\n"
    assert names(java, "java") == ["a", "c"]
    js = "class A {\n  a() { return 1; }\n  b() { return ) }\n  c() { return 3; }\n}\nfunction d() {}\n"
    assert names(js, "javascript") == ["a", "c", "d"]
    assert names("func a() {\n}\n\nfunc b( {\n}\nfunc c() {\n}\n", "go") == ["a", "c"]
    assert names("int a(void) { return 1; }\nint b(void) { return 2;\n", "c") == ["a"]


def test_dialects_do_not_mix():
    v = parsing.valid
    assert v("with (a) { b() }\n", "javascript") and v("import a from 'b';\nawait a();\n", "javascript") and not v("import a from 'b';\nwith (a) { b() }\n", "javascript")
    assert v("var let = 1, await = 2;\n", "javascript") and not v("export const let = 1;\n", "javascript")
    assert v("int f(a) int a; { return ({ a; }); }\n", "c") and v("[[nodiscard]] static bool f(int a) { return true; }\n", "c") and not v("[[nodiscard]] int f(a) int a; { return a; }\n", "c")
    assert v("SELECT `a` FROM b;", "sql") and v("SELECT a::int FROM b;", "sql") and v("SELECT @x, [a] FROM b;", "sql") and not v("SELECT `a`::int FROM b;", "sql")
    assert v("async = 1\nawait = async\n", "python") and v("if (n := f()) > 1:\n    pass\n", "python") and not v("async = (n := 1)\n", "python")
    assert v("async def f():\n    await g()\n", "python") and not v("print 'x'\n", "python") and names("async def f():\n    pass\nasync = 1\n", "python") == ["f"]
    assert [len(parsing.grammars.language(x).dialects) for x in ("javascript", "c", "sql", "python")] == [2, 2, 3, 2]
