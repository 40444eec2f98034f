import pytest

from loglens.operators import completion, import_names, imports, replay


def test_detect_columns():
    m = replay.detect_columns(["Question", "PROMPT", "Answer", "golden", "kb"])
    assert m[replay.INPUT] == "PROMPT" and m[replay.QUERY] == "PROMPT"
    assert m[replay.OUTPUT] == "Answer" and m[replay.TRUTH] == "golden" and m[replay.CONTEXTS] == "kb"
    assert replay.detect_columns(["input", "INPUT"])[replay.INPUT] == "INPUT"   # last of a case clash
    assert replay.pick_metrics(m) == ["correctness", "answer_relevance", "context_relevance", "groundedness", "coherence"]
    assert replay.pick_metrics({replay.OUTPUT: "o"}) == ["coherence"]
    with pytest.raises(ValueError):
        replay.require_output(replay.detect_columns(["prompt"]))


def test_imports_ast():
    src = "import a.b as c, d\nfrom e.f import g\nfrom . import h\nfrom .i import j\ndef k():\n    import l\n"
    assert sorted(imports.top_level_imports(src)[0]) == ["a", "d", "e", "i", "l"]
    names, err = imports.top_level_imports("def broken(:\n")
    assert names == [] and err.startswith("SyntaxError")


def test_files_that_break_the_parser_become_error_rows(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000
    chain = "x = " + "+".join(["1"] * 100_000)
    files = spark.createDataFrame([("deep.py", deep), ("chain.py", chain), ("bin.py", "a\x00b"), ("ok.py", "import deep")], "path string, content string")
    got = {r.path: (r["import"], bool(r.parse_error)) for r in imports.extract_imports(files).collect()}
    assert got["deep.py"] == (None, True) and got["bin.py"] == (None, True) and got["ok.py"] == ("deep", False)
    assert [(r.src, r.dst) for r in imports.import_edges(files).collect()] == [("ok", "deep")]


def test_source_tree_reader_and_edges(spark, tmp_path):
    from loglens.sources.source_tree import read_source_tree

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import b\nimport os\n")
    (tmp_path / "b.py").write_text("from a import x\nimport b\n")
    (tmp_path / "notes.txt").write_text("import a\n")
    files = read_source_tree(spark, str(tmp_path))
    assert files.count() == 2
    edges = sorted((r.src, r.dst) for r in imports.import_edges(files).collect())
    assert edges == [("a", "b"), ("b", "a"), ("b", "b")]


def test_completion_errors_and_order(spark):
    def fn(p):
        if "boom" in p:
            raise RuntimeError("bad chunk")
        return p.upper()

    df = spark.createDataFrame([(1, i, f"c{i}" if i != 2 else "boom") for i in range(4)], "doc_id long, chunk_idx int, p string")
    out = completion.complete(df, "p", "s", fn=fn).orderBy("chunk_idx").collect()
    assert [r.s for r in out] == ["C0", "C1", "[Error summarizing this section: bad chunk]", "C3"]
    stub = completion.complete(df, "p", "s", built_in=completion.stub_completion).orderBy("chunk_idx").first().s
    assert stub == "This is where the LLM response would be for: c0..."
    assert completion.complete(df, "p", "s").orderBy("chunk_idx").first().s.startswith("completion of 2 characters, ")


def test_summarise_with_function(spark):
    rows = [(1, i, f"chunk {i}", "T", "A", "", "K", "", "", 3) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, chunk string, title string, author string, subject string, "
                                     "keywords string, creation_date string, modification_date string, page_count int")
    out = completion.summarise(df, fn=lambda p: f"len{len(p)}").first()
    assert out.chunk_count == 3 and len(out.section_summaries) == 3 and out.final_summary.startswith("len")


def test_module_collisions_and_relative_imports(spark):
    files = spark.createDataFrame(
        [("a/x.py", "from . import y\nfrom .z import w\n"), ("b/x.py", "import z\n"), ("c/z.py", "")],
        "path string, content string")
    col = imports.module_collisions(files).collect()
    assert [(r.module, list(r.paths)) for r in col] == [("x", ["a/x.py", "b/x.py"])]
    assert {(r.module, r.path) for r in imports.module_nodes(files).collect()} == {("x", "b/x.py"), ("z", "c/z.py")}
    assert sorted((r.src, r.dst) for r in imports.import_edges(files).collect()) == [("x", "z")]


def test_imports_leave_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(imports, "OUT_ROWS", 7)
    many = "".join(f"import m{i}.x\n" for i in range(40))
    got = list(imports.import_batches(pa.array(["a.py", "b.py", "c.py", None]), pa.array([many, "def (", None, "import z"]), ["path", "import", "parse_error"]))
    assert max(b.num_rows for b in got) == 7
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert [r[1] for r in rows] == [*(f"m{i}" for i in range(40)), None, "z"] and rows[40][0] == "b.py" and "SyntaxError" in rows[40][2]


def test_parsed_names_stay_out_of_the_worker(monkeypatch):
    import subprocess
    import sys

    import pyarrow as pa

    # CPython keeps each name it has parsed: here the parsing process is another one, and is replaced
    code = ("import sys, pyarrow as pa; from loglens.operators import imports, import_names; import_names.PARSER_BYTES = 100_000\n"
            "texts = pa.array([''.join(f'import q{k}.core as c{k}\\n' for k in range(i, i + 1000)) for i in range(0, 40_000, 1000)])\n"
            "before = sys.getallocatedblocks()\n"
            "n = sum(b.num_rows for b in imports.import_batches(texts, texts, ['path', 'import', 'parse_error']))\n"
            "print(n, sys.getallocatedblocks() - before)")
    n, kept = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=imports.__file__.rpartition("/loglens/")[0]).stdout.split())
    assert n == 40_000 and kept < 20_000  # 120,000 and more if they stayed

    started = []
    real = subprocess.Popen
    monkeypatch.setattr(subprocess, "Popen", lambda *a, **k: started.append(real(*a, **k)) or started[-1])
    monkeypatch.setattr(imports, "PARSE_FILES", 2)
    monkeypatch.setattr(import_names, "PARSER_BYTES", 60)
    texts = ["import a\n", "def (", None, "x" * 100 + "\nimport b", "\0", "import c, d.e\n" * 3, "import f"]
    got = [r for b in imports.import_batches(pa.array(list("stuvwxy")), pa.array(texts), ["path", "import", "parse_error"]) for r in b.to_pylist()]
    assert [(r["path"], r["import"]) for r in got] == [("s", "a"), ("t", None), ("v", "b"), ("w", None), *[("x", i) for i in "cd" * 3], ("y", "f")]
    assert [r["parse_error"] for r in got if r["path"] in "tw"] == [imports.top_level_imports(t)[1] for t in ("def (", "\0")]
    assert len(started) > 1 and all(p.returncode == 0 for p in started)
