"""A small Python project from source text to answers."""

import pytest

from graphloom.engine import Engine

CODE = {
    "app/core.py": "import os\n\nclass Base:\n    pass\n\nclass Store(Base):\n    def load(self, key):\n        if key:\n            return fetch(key)\n        return None\n\ndef fetch(key):\n    return os.getenv(key)\n",
    "app/api.py": "from app.core import fetch\n\ndef main():\n    eval('x')\n    return serve()\n\ndef serve():\n    return fetch('a')\n",
    "app/test_api.py": "from app.api import serve\n\ndef test_serve():\n    serve()\n",
    "app/broken.py": "def (",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in CODE.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.py").write_text("def hidden(): pass\n")
    made = Engine.analyze(spark, str(root))
    out = str(tmp_path_factory.mktemp("graph"))
    made.save(out)
    return Engine.load(spark, out)


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_graph(engine):
    assert {r["kind"]: r["n"] for r in engine.status().collect()} == {"file": 4, "class": 2, "method": 1, "function": 4}
    kinds = {r["kind"] for r in engine.edges.select("kind").distinct().collect()}
    assert kinds == {"contains", "calls", "imports", "extends"}


def test_questions(engine):
    assert names(engine.impact("fetch", 1)) == ["fetch", "load", "serve"]
    assert set(names(engine.callers("fetch"))) == {"load", "serve", "main", "test_serve"}
    assert "fetch" in names(engine.trace("main", 3)[0]) and "serve" in names(engine.context("main", 1))
    assert names(engine.search("fetch", mode="keyword")) == ["fetch"] and "serve" in names(engine.search("serve"))
    assert names(engine.suggest("se"))[0] == "serve" or "serve" in names(engine.suggest("se"))
    assert names(engine.test_gaps()) == ["load", "main"]
    assert sorted((r["test"] is not None, r["link"]) for r in engine.test_links().collect()) == [(True, "direct"), (True, "transitive")]


def test_scores(engine):
    risk = {r["name"]: r for r in engine.risk().collect()}
    assert risk["fetch"]["blastRadius"] == 2 and risk["main"]["testCoverage"] == 10 and all(0 <= r["score"] <= 100 for r in risk.values())
    assert engine.hotspots(2).count() == 2
    assert [(r["category"], r["line"]) for r in engine.findings().collect()] == [("command_injection", 4)]
    assert engine.security_score().first()["taint"] == 80
    assert engine.communities().count() > 0 and engine.processes().count() > 0
