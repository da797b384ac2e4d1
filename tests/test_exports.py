"""Public symbols and their uses: names, aliases, members, re-exports in chains and circles, both languages."""

from codestrata.operators import exports

PYTHON = {
    "lib/__init__.py": "from .core import run as go, Engine\nfrom .extra import *\n",
    "lib/core.py": "LIMIT = 3\n\nclass Engine:\n    def inner(self): pass\n\ndef run(): pass\n\ndef unused(): pass\ndef _hidden(): pass\n",
    "lib/extra.py": "__all__ = ['one', \"two\"]\ndef one(): pass\ndef two(): pass\ndef three(): pass\n",
    "lib/sub/deep.py": "from ..core import LIMIT\nfrom .. import core as c\nc.run()\n",
    "app.py": "import lib.core as lc\nfrom lib import (go,  # start\n    one as uno)\nlc.LIMIT\nx.unused\n",
    "tool.py": "import core\nprint(core.run())\nfrom lib import Engine, missing\n",
    "ring_a.py": "from ring_b import thing\n",
    "ring_b.py": "from ring_a import thing\n",
    "wild.py": "from lib.extra import *\nasync def task(): pass\n",
}
SCRIPT = {
    "src/index.ts": "export { make as build } from './make';\nexport * from './shapes/circle';\nexport const VERSION = 1;\n",
    "src/make.js": "export default function make() {}\nexport function make() {}\nexport class Maker {}\nexport { local as renamed, other };\n",
    "src/shapes/circle.tsx": "export interface Circle {}\nexport type Radius = number;\nexport async function area() {}\n",
    "src/use.js": "import { build, Circle } from '.';\nimport made, { Maker as M } from './make.js';\nimport * as ns from './shapes/circle';\nns.area();\n",
    "lib/old.js": "const { renamed: r, other } = require('../src/make');\nimport { x } from 'package';\n",
}


def found(analyse, files):
    rows = analyse(lambda i: exports.public_exports(i.tree), {"r": files}, signals=["manifest", "symbols", "links"])
    assert all(r[6] == (r[5] > 0) and r[0] == "r" for r in rows)
    return {(r[1], r[2]): (r[3], r[4], r[5]) for r in rows}


def test_python(analyse):
    assert found(analyse, PYTHON) == {
        ("lib/core.py", "LIMIT"): ("constant", 1, 2), ("lib/core.py", "Engine"): ("class", 3, 2),
        ("lib/core.py", "run"): ("function", 6, 4), ("lib/core.py", "unused"): ("function", 8, 0),
        ("lib/extra.py", "one"): ("function", 2, 3), ("lib/extra.py", "two"): ("function", 3, 2),
        ("wild.py", "task"): ("function", 2, 0),
    }


def test_script(analyse):
    assert found(analyse, SCRIPT) == {
        ("src/index.ts", "VERSION"): ("constant", 3, 0), ("src/make.js", "default"): ("function", 1, 1),
        ("src/make.js", "make"): ("function", 2, 2), ("src/make.js", "Maker"): ("class", 3, 1),
        ("src/make.js", "renamed"): ("name", 4, 1), ("src/make.js", "other"): ("name", 4, 1),
        ("src/shapes/circle.tsx", "Circle"): ("interface", 1, 2), ("src/shapes/circle.tsx", "Radius"): ("type", 2, 1),
        ("src/shapes/circle.tsx", "area"): ("function", 3, 2),
    }


def test_a_long_chain_of_hand_overs(analyse):
    files = {f"m{n}.py": f"from m{n + 1} import thing\n" for n in range(12)} | {"m12.py": "def thing(): pass\n"}
    assert found(analyse, files) == {("m12.py", "thing"): ("function", 1, 12)}


def test_nothing_to_export(analyse):
    assert found(analyse, {"a.md": "def x(): pass\n", "b.py": "", "c.js": "let a = 1\n"}) == {}
