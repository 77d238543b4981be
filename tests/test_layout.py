"""What stands where: the package never needs the training-data operators."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return found


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "chalkline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(m.startswith(("chalkline.llm", "corpus_pipeline")) for m in imports(path)), path


def test_no_local_checkpoints_and_plain_layers():
    for path in (ROOT / "chalkline").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" + "(" not in text, path
        if path.parent.name == "functions":
            assert not any(m.startswith(("chalkline.operators", "chalkline.plans", "chalkline.sources")) for m in imports(path)), path
        if path.parent.name == "operators":
            assert not any(m.startswith("chalkline.plans") for m in imports(path)), path


def test_entry_lives_without_them(tmp_path):
    import subprocess
    import sys

    code = "import sys; sys.modules['chalkline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(k.startswith('op1_') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1:] == ["False", "False"]
