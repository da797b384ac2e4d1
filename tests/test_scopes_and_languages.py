"""Corpus filters, file facts and languages on small hand-made repositories."""

import fnmatch

from codestrata.operators import facts, languages


def paths(rows):
    return sorted(r[0] for r in rows)


def test_file_facts(analyse):
    files = {"r": {"src/a.tar.gz": "x\ny", ".env": "A=1\n", "Makefile": "", "b.Py": "1\n2\n"}}
    rows = analyse(
        lambda i: i.facts.select("path", "stem", "suffix", "suffix_lower", "depth", "top_dir", "line_count"),
        files, signals=["manifest"],
    )
    assert sorted(rows) == [
        (".env", ".env", "", "", 1, None, 1),
        ("Makefile", "Makefile", "", "", 1, None, 0),
        ("b.Py", "b", ".Py", ".py", 1, None, 2),
        ("src/a.tar.gz", "a.tar", ".gz", ".gz", 2, "src", 2),
    ]


def test_line_ends_are_normalised(analyse):
    rows = analyse(lambda i: i.facts.select("line_count"), {"r": {"a.py": "a\r\nb\rc"}}, signals=["todos"])
    assert rows == [(3,)]


def test_walk(analyse):
    keep = ["a.py", ".env", "pkg/ok.py", "logs.txt", "x/secret.py"]
    drop = [
        "node_modules/x.js", ".git/config", "a/__pycache__/x.py", ".hidden/x.py", "logo.PNG", "run.log",
        "deep/run.log", "top/x.py", "a/tmpdir/y.py", "gen_1.py", "pic.svg",
    ]
    ignore = "# comment\n*.log\n\n/top\ntmpdir\ngen_?.py\nsecret/\n"
    files = {"r": {p: "x" for p in keep + drop} | {".gitignore": ignore}, "other": {"run.log": "x", "top/x.py": "y"}}
    rows = analyse(lambda i: i.tree.select("repo", "path"), files, signals=["manifest"])
    assert sorted(rows) == sorted([("r", p) for p in [*keep, ".gitignore"]] + [("other", "run.log"), ("other", "top/x.py")])


def test_ignore_rules_agree_with_shell_globs(analyse):
    """Brute force: a file is out when a rule fits one of its components or the path of one of its folders."""
    rules = ["*.log", "/docs/*.txt", "build[12]", "a?c", "x[!y]z", "src/*/gen", "plain.txt", "w[", "+(a).b"]
    names = [
        "a.log", "docs/a.txt", "docs/sub/a.txt", "build1/a", "build3/a", "abc", "q/abc/r", "ac", "xaz", "xyz",
        "src/m/gen/out.py", "src/m/n/gen/out.py", "src/gen/o", "plain.txt", "k/plain.txt", "w[", "w", "+(a).b", "a.b",
        "docs/a.txt.bak", "Abc", "A.LOG",
    ]

    def out(path):
        parts = path.split("/")
        tested = parts + ["/".join(parts[: n + 1]) for n in range(len(parts))]
        return any(fnmatch.fnmatchcase(c, r.lstrip("/")) for r in rules for c in tested)

    files = {"r": {n: "x" for n in names} | {".gitignore": "\n".join(rules)}}
    rows = analyse(lambda i: facts.drop_ignored(i.facts, i.corpus.rules).select("path"), files, signals=["manifest"])
    assert paths(rows) == sorted([n for n in names if not out(n)] + [".gitignore"])


def test_size_limit_is_strict(analyse):
    files = {"r": {"big.txt": "x" * (1024 * 1024 + 1), "edge.txt": "x" * (1024 * 1024)}}
    assert paths(analyse(lambda i: i.facts.where(facts.within_size()).select("path"), files)) == ["edge.txt"]
    assert paths(analyse(lambda i: i.tree.select("path"), files, signals=["manifest"])) == ["big.txt", "edge.txt"]


def test_scan_scope_skips_only_its_folders(analyse):
    files = {"r": {"dist/a.js": "", ".github/a.yml": "", "a/.next/b.js": "", "distx/a.js": "", ".env": ""}}
    rows = analyse(lambda i: i.facts.where("scannable").select("path"), files, signals=["manifest"])
    assert paths(rows) == [".env", ".github/a.yml", "distx/a.js"]


def test_languages(analyse):
    files = {
        "mix": {"a.py": "1\n", "b.py": "", "c.ts": "", "d.js": "", "x.unknown": "", "Dockerfile": "", "S.R": ""},
        "odd": {"LICENSE": "a", "x.abc": "b"},
    }
    rows = analyse(lambda i: languages.language_breakdown(i.tree), files, signals=["manifest"])
    assert sorted(rows) == sorted([
        ("mix", "Python", 2, 1, 33.33), ("mix", "TypeScript", 1, 0, 16.67), ("mix", "JavaScript", 1, 0, 16.67),
        ("mix", "Dockerfile", 1, 0, 16.67), ("mix", "R", 1, 0, 16.67), ("odd", "Other", 2, 2, 100.0),
    ])


def test_empty_corpus_gives_no_rows(analyse):
    assert analyse(lambda i: languages.language_breakdown(i.tree), {}, signals=["manifest"]) == []
    assert analyse(lambda i: languages.corpus_totals(i.tree), {}, signals=["manifest"]) == []
