"""Manifests: dependencies, risk and the setup guide."""

from codestrata.operators import dependencies, setup

M = ["manifest"]


def deps(analyse, files):
    rows = analyse(lambda i: dependencies.dependencies(i.facts), {"r": files}, signals=M)
    return [(n, v, lic, s) for _, _, n, v, lic, s in sorted(rows, key=lambda r: r[1])]


def test_requirements(analyse):
    text = (
        "flask==0.12.0\nrequests>=2.28.0,<3\n# note\n-r more.txt\n\n  Django[argon2] ~= 3.2 \nnumpy\nfoo; python_version<'3'\n"
        "celery==4.4\ntornado==0.9\npandas===1.0\n"
    )
    assert deps(analyse, {"requirements.txt": text}) == [
        ("flask", "0.12.0", None, "outdated"), ("requests", "2.28.0,<3", None, "ok"), ("Django", "3.2", None, "outdated"),
        ("numpy", "unknown", None, "unknown"), ("foo; python_version<'3'", "unknown", None, "unknown"),
        ("celery", "4.4", None, "ok"), ("tornado", "0.9", None, "outdated"), ("pandas", "1.0", None, "ok"),
    ]


def test_pyproject(analyse):
    text = (
        '[build-system]\nrequires = ["wheel"]\ndependencies = ["not-this"]\n\n[project]\nname = "x"\ndependencies = [\n'
        "  \"httpx>=0.27\",  # a ] comment\n  'pydantic[email]>=2',\n]\n[project.optional-dependencies]\ndependencies = [\"nor-this\"]\n"
    )
    assert deps(analyse, {"pyproject.toml": text}) == [("httpx", "0.27", None, "ok"), ("pydantic", "2", None, "ok")]


def test_long_dependency_list_does_not_exhaust_the_matcher(analyse):
    items = "".join(f'  "package-{n}>={n}.0",\n' for n in range(20000))
    rows = deps(analyse, {"pyproject.toml": f"[project]\ndependencies = [\n{items}]\n"})
    assert len(rows) == 20000 and rows[-1][:2] == ("package-19999", "19999.0")


def test_package_json_and_precedence(analyse):
    files = {
        "requirements.txt": "React==1\n",
        "package.json": '{"license":"MIT","dependencies":{"next":"^14.0.1","react":"18"},"devDependencies":{"jest":""}}',
        "sub/package.json": '{"dependencies":{"ignored":"1"}}',
    }
    assert deps(analyse, files) == [
        ("React", "1", None, "ok"), ("next", "14.0.1", "MIT", "ok"), ("jest", "unknown", "MIT", "unknown"),
    ]


def test_go_cargo_and_gems(analyse):
    go = "module m\n\ngo 1.21\n\nrequire a.com/b v1.2.3\nrequire (\n\tc.com/d v0.1.0 // indirect\n)\n"
    cargo = (
        '[package]\nname = "c"\nversion = "9"\n[dependencies]\nserde = "^1.0"\ntokio = { version = "1.2", features = ["full"] }\n'
        'path-only = { path = "../x" }\n[dependencies.log]\nversion = "0.4"\n[dev-dependencies]\nrand = "0.8"\n'
    )
    gems = "source 'x'\ngem 'rails', '~> 7.1'\n  gem \"puma\"\n# gem 'no'\ngemspec\n"
    rows = deps(analyse, {"go.mod": go, "Cargo.toml": cargo, "Gemfile": gems})
    assert [(n, v) for n, v, _, _ in rows] == [
        ("a.com/b", "1.2.3"), ("c.com/d", "0.1.0"), ("serde", "1.0"), ("tokio", "1.2"), ("path-only", "unknown"),
        ("log", "0.4"), ("rand", "0.8"), ("rails", "7.1"), ("puma", "unknown"),
    ]


def test_managers_and_risk(analyse):
    repos = {
        "none": {"a.txt": ""},
        "pip": {"requirements.txt": "flask==0.1\nrequests==2.0\n"},
        "npm": {"package.json": "{}"},
        "npm_over_pip": {"requirements.txt": "", "package.json": '{"dependencies":{"a":"1"}}'},
        "pip_kept": {"requirements.txt": "", "package.json": "{}"},
        "bare_toml": {"pyproject.toml": "[project]\n", "go.mod": ""},
        "cargo": {"Cargo.toml": ""},
        "gem": {"Gemfile": ""},
        "many": {"requirements.txt": "".join(f"p{i}==1\n" for i in range(101))},
    }
    rows = dict(analyse(lambda i: dependencies.package_manager(i.facts), repos, signals=M))
    assert rows == {
        "none": "none", "pip": "pip", "npm": "npm", "npm_over_pip": "npm", "pip_kept": "pip", "bare_toml": "go",
        "cargo": "cargo", "gem": "bundler", "many": "pip",
    }
    risks = {r[0]: (r[1], r[3], r[5]) for r in analyse(lambda i: dependencies.dependency_risk(i.facts), repos, signals=M)}
    assert risks["pip"] == (2, 1, 20) and risks["none"] == (0, 0, 0) and risks["many"] == (101, 0, 20)


def test_prerequisites_and_install(analyse):
    repos = {
        "py": {"pyproject.toml": "[project]\nname = \"x\"\nrequires-python = '>=3.10'\n", "requirements.txt": ""},
        "unnamed": {"pyproject.toml": "[tool]\nname = \"x\"\n", "requirements.txt": ""},
        "cfg": {"setup.cfg": "python_requires = >=3.9 \n"},
        "js": {"package.json": '{"engines":{"node":">=18"}}', "pnpm-lock.yaml": "", ".env.example": "A=1"},
        "more": {"go.mod": "module x\ngo 1.21\n", "Cargo.toml": "", "Dockerfile": "", "sub/setup.py": ""},
    }
    rows = analyse(lambda i: setup.prerequisites(i.facts), repos, signals=M)
    assert sorted(r[:4] for r in rows) == [
        ("cfg", 1, "python", ">=3.9"), ("js", 1, "node.js", ">=18"), ("more", 1, "docker", None), ("more", 2, "go", "1.21"),
        ("more", 3, "rust", None), ("py", 1, "python", ">=3.10"), ("unnamed", 1, "python", None),
    ]
    steps = analyse(lambda i: setup.install_steps(i.facts), repos, signals=M)
    assert sorted((r[0], r[1], r[3]) for r in steps) == [
        ("js", 1, "pnpm install"), ("js", 2, "cp .env.example .env"), ("more", 1, "go mod download"), ("more", 2, "cargo build"),
        ("py", 1, "pip install -r requirements.txt"), ("py", 2, "pip install -e ."), ("unnamed", 1, "pip install -r requirements.txt"),
    ]


def test_environment_variables(analyse):
    repos = {
        "r": {
            ".env.example": "# c\nDATABASE_URL=postgres://x\nTOKEN=\nTOKEN=abc\nlower=1\n EMPTY = \n", ".env": "TOKEN=1\nONLY_ENV=2\n",
            "a.py": "os.environ.get('PY_VAR')\nos.environ['NO']\nos.environ.get(\"DATABASE_URL\")", "a.js": "process.env.JS_VAR",
            "b.ts": "process.env.TS_VAR", "dist/c.py": "os.environ.get('SKIPPED')",
        },
        "ts": {"b.ts": "process.env.TS_VAR"},
        "hidden_js": {"b.ts": "process.env.TS_VAR", "node_modules/x.js": ""},
    }
    rows = analyse(lambda i: setup.env_vars(i.facts), repos, signals=["manifest", "env_names"])
    assert sorted(rows, key=str) == sorted([
        ("r", "DATABASE_URL", True, "postgres://x"), ("r", "TOKEN", True, "abc"), ("r", "EMPTY", True, None),
        ("r", "ONLY_ENV", False, None), ("r", "PY_VAR", False, None), ("r", "JS_VAR", False, None), ("ts", "TS_VAR", False, None),
    ], key=str)


def test_run_and_test_commands(analyse):
    readme = (
        "# x\n```bash\nflask run --debug\nFLASK RUN\npython app.py\n```\n```python\nnode x\n```\ntext python y\n```\nnode server.js\n```\n"
    )
    repos = {
        "r": {"README.md": readme, "package.json": '{"scripts":{"dev":"x","start":"y","test":"mocha","build":"z"}}'},
        "jest": {"package.json": '{"scripts":{"test":"Jest --ci"}}'},
        "pytest": {"requirements.txt": "PyTest\n", "go.mod": ""},
        "go": {"go.mod": ""}, "rust": {"Cargo.toml": ""}, "none": {"a": ""},
        "db": {"docker-compose.yaml": "image: redis"},
    }
    rows = analyse(lambda i: setup.run_commands(i.facts), repos, signals=M)
    # the fence that closes the python block opens the next match, which ends at the following fence
    assert sorted(rows) == [
        ("r", "dev", "npm run dev"), ("r", "flask", "flask run --debug"), ("r", "python", "python app.py"), ("r", "start", "npm start"),
    ]
    tests = dict(analyse(lambda i: setup.test_command(i.facts), repos, signals=M))
    assert tests == {
        "r": "mocha", "jest": "jest", "pytest": "pytest", "go": "go test ./...", "rust": "cargo test", "none": None, "db": None,
    }
    builds = dict(analyse(lambda i: setup.build_command(i.facts), repos, signals=M))
    assert builds["r"] == "npm run build" and builds["jest"] is None
    assert [r[0] for r in analyse(lambda i: setup.database_setup(i.facts), repos, signals=M)] == ["db"]
    issues = analyse(lambda i: setup.common_issues(i.facts), repos, signals=M)
    assert sorted((r[0], r[1]) for r in issues) == [("jest", 1), ("pytest", 1), ("r", 1)]
