"""Architecture and technical debt on small hand-made repositories."""

from codestrata.operators import architecture, debt

ARCH = ["manifest", "imports"]
DEBT = ["manifest", "imports", "todos", "opens_with_docstring"]


def one(rows):
    return {r[0]: r[1:] for r in rows}


def test_frameworks(analyse):
    repos = {
        "flask": {"requirements.txt": "requests\nFlask==2\n"},
        "eof": {"requirements.txt": "flask"},
        "quoted": {"pyproject.toml": '[project]\ndependencies = [\n"flask>=2"\n]\n'},
        "next": {"package.json": '{"dependencies": {"react": "1", "next": "2"}}'},
        "dev": {"package.json": '{"devDependencies": {"@nestjs/core": "1"}}'},
        "bad": {"package.json": "{oops"},
        "manage": {"x/manage.py": ""},
        "order": {"setup.cfg": "[o]\n django >= 3\n", "package.json": '{"dependencies": {"vue": "3"}}'},
        "last": {"a/requirements.txt": "flask==1\n", "b/requirements.txt": "tornado>1\n"},
    }
    rows = one(analyse(lambda i: architecture.framework(i.tree), repos, signals=ARCH))
    assert {k: v[0] for k, v in rows.items()} == {
        "flask": "flask", "eof": None, "quoted": None, "next": "nextjs", "dev": "nestjs", "bad": None,
        "manage": "django", "order": "django", "last": "tornado",
    }


def test_project_types(analyse):
    repos = {
        "mono": {"packages/a/x.py": ""},
        "cli": {"src/cli.py": ""},
        "library": {"pyproject.toml": "[project]\nname='x'\n"},
        "scripts": {"pyproject.toml": "[project]\n[project.scripts]\n"},
        "nested": {"sub/pyproject.toml": "[project]\n"},
        "web": {"pyproject.toml": "[project]\n", "requirements.txt": "flask==1\n"},
        "plain": {"a.txt": ""},
    }
    rows = one(analyse(lambda i: architecture.project_type(i.tree, i.facts), repos, signals=ARCH))
    assert {k: v[1] for k, v in rows.items()} == {
        "mono": "monorepo", "cli": "cli", "library": "library", "scripts": "monolith", "nested": "monolith",
        "web": "monolith", "plain": "monolith",
    }


def test_structure_patterns(analyse):
    repos = {
        "clean": {"Domain/a.py": "", "models/b.py": ""},
        "mvc": {"Models/a.py": "", "views/b.py": ""},
        "feature": {"users/a.py": "", "orders/b.py": "", "models/c.py": ""},
        "flat": {"a.py": "", "users/b.py": "", "tests/c.py": ""},
        "bare": {"a.py": ""},
    }
    rows = one(analyse(lambda i: architecture.structure_pattern(i.tree), repos, signals=ARCH))
    assert {k: v[0] for k, v in rows.items()} == {
        "clean": "clean", "mvc": "mvc", "feature": "feature-based", "flat": "flat", "bare": "flat",
    }


def test_import_graph_and_key_files(analyse):
    repo = {
        "app.py": "import utils\nimport core.db\nfrom models import User\n",
        "utils.py": "import utils\n",
        "models.py": "import utils\n",
        "core/db.py": "from utils import x\n",
        "web.js": "import x from 'utils';\nimport y from './models';\n",
        "README.md": "# hi\n",
        "pyproject.toml": "",
    }
    edges = analyse(lambda i: architecture.import_edges(i.tree), {"r": repo, "s": {"a.py": "import utils\n"}}, signals=ARCH)
    assert sorted(edges) == [
        ("r", "app.py", "models.py"), ("r", "app.py", "utils.py"), ("r", "core/db.py", "utils.py"),
        ("r", "models.py", "utils.py"), ("r", "web.js", "utils.py"),
    ]
    keys = analyse(lambda i: architecture.key_files(i.tree), {"r": repo}, signals=ARCH)
    assert sorted(keys, key=lambda r: r[1]) == [
        ("r", 1, "app.py", "entry point", 50), ("r", 2, "utils.py", "module", 40),
        ("r", 3, "README.md", "documentation", 10), ("r", 4, "models.py", "module", 10),
        ("r", 5, "pyproject.toml", "package config", 10), ("r", 6, "core/db.py", "module", 0),
        ("r", 7, "web.js", "module", 0),
    ]


def test_last_file_of_a_module_name_wins(analyse):
    repo = {"a/x.py": "", "b/x.py": "", "m.py": "import x\n"}
    assert analyse(lambda i: architecture.import_edges(i.tree), {"r": repo}, signals=ARCH) == [("r", "m.py", "b/x.py")]


def test_todo_density(analyse):
    repos = {"many": {"a.py": "# TODO x\n" * 20}, "few": {"a.py": "x\n" * 399 + "# FIXME\n"}, "none": {"a.txt": "# TODO\n"}}
    rows = one(analyse(lambda i: debt.todo_density(i.tree), repos, signals=DEBT))
    assert rows == {
        "many": (20, 20, 100, "20 TODO/FIXME/HACK comments across 20 lines (1000.0 per 1000 lines)"),
        "few": (1, 400, 25, "1 TODO/FIXME/HACK comments across 400 lines (2.5 per 1000 lines)"),
        "none": (0, 0, 0, "No source files found."),
    }


def test_coverage_complexity_and_hotspots(analyse):
    repo = {"a.py": "x\n" * 600, "b.py": "x\n" * 500, "c.js": "x\n", "tests/t.py": "x\n", "spec_d.ts": "x\n"}
    assert analyse(lambda i: debt.test_ratio(i.tree), {"r": repo}, signals=DEBT) == [
        ("r", 2, 3, 0, "2 test files vs 3 source files (ratio: 0.67)")
    ]
    assert analyse(lambda i: debt.complexity(i.tree), {"r": repo}, signals=DEBT) == [
        ("r", 1, 5, 40, "1 files exceed 500 lines.")
    ]
    assert analyse(lambda i: debt.hotspots(i.tree), {"r": repo}, signals=DEBT) == [
        ("r", 1, "a.py", "File has 600 lines (threshold: 500)", 52)
    ]


def test_documentation_and_dead_code(analyse):
    repo = {
        "a.py": '"""Doc."""\nimport b\n', "b.py": "  '''doc'''\n", "c.py": "", "d.py": "import d\n",
        "pkg/__init__.py": "", "test_x.py": "",
    }
    assert analyse(lambda i: debt.documentation_gap(i.tree), {"r": repo}, signals=DEBT) == [
        ("r", 4, 6, 66, "4/6 Python files lack module docstrings (67%)")
    ]
    dead = analyse(lambda i: debt.dead_modules(i.tree), {"r": repo}, signals=DEBT)
    assert sorted(p for _, p in dead) == ["a.py", "c.py"]
    assert analyse(lambda i: debt.dead_code(i.tree), {"r": repo}, signals=DEBT) == [
        ("r", 2, 6, 0, "2/6 Python files have no imports from internal modules.")
    ]


def test_score_and_advice(analyse):
    repos = {"awful": {f"m{i}.py": "# TODO x\n" * 501 for i in range(4)}, "none": {"x.txt": ""}}
    rows = one(analyse(lambda i: debt.debt_score(i.tree), repos, signals=DEBT))
    # 100 points in todos, tests, complexity, documentation and dead code: 15 + 20 + 20 + 15 + 10
    assert rows == {"awful": (80, "D"), "none": (0, "A")}
    advice = analyse(lambda i: debt.debt_recommendations(i.tree), repos, signals=DEBT)
    assert [(r, d) for _, r, d, _ in sorted(advice)] == [
        (1, "todo_density"), (2, "test_coverage"), (3, "complexity"), (4, "documentation"), (5, "dead_code"),
    ]
    dims = analyse(lambda i: debt.debt_dimensions(i.tree), repos, signals=DEBT)
    assert len(dims) == 14 and all(0 <= d[3] <= 100 for d in dims)
