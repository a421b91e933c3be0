"""Host context and protocol of tests in small checkouts."""

from runsift.operators import context

TEST = '''import os
from ..models import Thing, Other
from . import helpers
from .sub.models import *
pytestmark = 1

class Base:
    pass

class TestA(Base, object):
    size: int = 3
    def setUp(self):
        self.x = 1
    def test_one(self):
        pass
    @mark.slow
    def test_two(self, db, tmp):
        make(Thing, size)
    def tearDown(self): pass

def test_three(db):
    def test_inner(): pass

def test_four(): pass
'''
FILES = {
    "app/tests/test_x.py": TEST,
    "app/models.py": "class Thing:\n    a = 1\n\nclass Unused: pass\n\nclass Other: pass\n",
    "app/tests/sub/models.py": "class Sub: pass\n",
    "app/tests/helpers.py": "def make(): pass\ndef unused(): pass\nclass size: pass\n",
    "app/tests/models.py": "class Thing: pass\ndef make(): return 2\n",
    "app/tests/conftest.py": "@pytest.fixture(scope='x')\ndef db(): return 1\n@fixture\ndef other(): pass\ndef tmp(): pass\n",
    "conftest.py": "import pytest\n@pytest.fixture\ndef tmp(): pass\n@pytest.fixture\ndef db(): return 2\n",
    "app/conftest.py": "def broken(:\n",
    "broken.py": "def f(:\nimport os\npytestmark = x\n",
}


def given(spark):
    tests = [
        ("a", "c", "app/tests/test_x.py", "TestA.test_two", "retrieved", "x/flask", "1"),
        ("b", "c", "app/tests/test_x.py", "test_three", "retrieved", "", "1"),
        ("m", "c", "gone/test_y.py", "", "import re\ndef test_gone(self, z):\n    pass\n", "a/seaborn", "1"),
        ("s", "c", "broken.py", "test_q", "x", "a/unknown", "1"),
        ("o", "d", "app/tests/test_x.py", "TestB.test_two", TEST, "x/flask", "1"),
    ]
    files = spark.createDataFrame([("c", p, t) for p, t in FILES.items()] + [("d", "app/models.py", "class Thing: pass")], "checkout string, path string, text string")
    return spark.createDataFrame(tests, "instance_id string, checkout string, file string, name string, content string, repo string, version string"), files


def test_host_contexts(spark):
    got = {r.instance_id: r for r in context.host_contexts(*given(spark)).collect()}
    a, b, m, s, o = (got[k] for k in "abmso")
    assert (a.host_class, a.seed_test_name, a.seed_test_code) == ("TestA", "test_two", "def test_two(self, db, tmp):\n        make(Thing, size)")
    assert a.imports.splitlines()[-1] == a.pytestmark == "pytestmark = 1" and len(a.imports.splitlines()) == 5
    assert a.setup_context == "class TestA(Base, object):\n\nsize: int = 3\n\ndef setUp(self):\n        self.x = 1\n\ndef tearDown(self): pass"
    assert a.model_context == "# app/models.py\nclass Thing:\n    a = 1\n\n# app/models.py\nclass Other: pass\n\n# app/tests/sub/models.py\nclass Sub: pass"
    assert (a.fixtures, a.decorators, a.warnings) == (["db", "tmp"], ["mark.slow"], [])
    assert a.test_command.endswith("app/tests/test_x.py::TestA::test_two") and a.seed_execution_status == "SKIPPED"
    assert [c.split("(")[0] for c in a.adjacent_tests] == ["def test_one", "def test_three", "def test_inner"]
    assert (b.host_class, b.setup_context, b.fixtures, b.test_command) == ("", "", ["db"], "python -m pytest app/tests/test_x.py -q")
    assert [c.split("(")[0] for c in b.adjacent_tests] == ["def test_one", "def test_two", "def test_inner", "def test_four"]
    assert (m.seed_test_name, m.fixtures, m.warnings) == ("test_gone", ["z"], [context.NOT_IN_CHECKOUT]) and m.imports == "import re"
    assert (s.seed_test_code, s.imports, s.pytestmark, s.test_command) == ("x", "import os\npytestmark = x", "pytestmark = x", None) and s.warnings == [context.NOT_IN_FILE]
    assert (o.host_class, o.fixtures, o.warnings) == ("", [], [context.NOT_IN_CHECKOUT, context.NOT_IN_FILE]) and o.model_context == "# app/models.py\nclass Thing: pass"


def test_protocols(spark):
    got = {r.instance_id: r for r in context.protocols(*given(spark)).collect()}
    a, b, m, s, o = (got[k] for k in "abmso")
    assert a.class_context == "class TestA(Base, object):\nsize: int = 3" and a.setup_methods == ["def setUp(self):\n        self.x = 1"] and a.teardown_methods == ["def tearDown(self): pass"]
    assert [(c.file, [f.name for f in c.fixtures]) for c in a.conftest_context] == [("app/tests/conftest.py", ["db"]), ("conftest.py", ["tmp", "db"])]
    assert [(x.name, x.file) for x in a.local_helpers] == [("make", "app/tests/models.py"), ("make", "app/tests/helpers.py"), ("size", "app/tests/helpers.py")]
    assert [(x.name, x.file) for x in a.local_models] == [("Thing", "app/tests/models.py")] and a.protocol_risks == [] and a.placement_dir == "app/tests"
    assert (a.pytest_marks, len(a.imports), a.decorators, a.test_framework) == (["pytestmark = 1"], 4, ["mark.slow"], "pytest")
    assert [c.file for c in b.conftest_context] == ["app/tests/conftest.py", "conftest.py"] and b.setup_methods == [] and b.class_context == ""
    assert m.protocol_risks == [context.NO_FILE, context.NO_TARGET] and m.selected_seed_name == ""
    assert s.protocol_risks == [context.NO_TREE, context.NO_TARGET] and s.placement_dir == "."
    # A test that asks for none is shown all that it can reach.
    assert [(c.file, len(c.fixtures)) for c in s.conftest_context] == [("conftest.py", 2)]
    assert o.protocol_risks == [context.NO_FILE, context.NO_TARGET] and o.conftest_context == []
    fixture = spark.createDataFrame([("f", "e", "t.py", "test_a", "def test_a(plug): pass", "x/flask", "1")], "instance_id string, checkout string, file string, name string, content string, repo string, version string")
    files = spark.createDataFrame([("e", "t.py", "def test_a(plug): pass")], "checkout string, path string, text string")
    assert context.protocols(fixture, files).first().protocol_risks == [context.NO_FIXTURE]
    assert context.protocols(fixture.where("false"), files).count() == context.host_contexts(fixture.where("false"), files).count() == 0
