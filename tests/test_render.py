"""Rendered pages, and the entry module without the subpackage llm."""

import subprocess
import sys
from pathlib import Path

from veriloom import render as R


def test_tables(spark):
    df = spark.createDataFrame([(2, "a|b", "absent"), (1, "x\ny", "faithful"), (3, None, "partial")], "k int, t string, v string")
    assert R.markdown_table(df, ["t", "v"], ["k"], "v") == "| t | v |\n|---|---|\n| x y | faithful |\n| a\\|b | **absent** |\n|  | partial |\n"
    assert "<td>x\ny</td>" in R.page_html("T & t", df, ["t"], ["k"]) and "T &amp; t" in R.page_html("T & t", df, ["t"], ["k"])


def test_tree_and_brief(spark):
    n = spark.createDataFrame([("r", None, 0), ("b", "r", 2), ("a", "r", 1)], "node string, parent string, ord long")
    j = spark.createDataFrame([("r", "fails", "b"), ("a", "holds", ""), ("b", "fails", "")], "node string, judgement string, deciding string")
    assert R.tree_text(n, j) == "r: fails (b)\n  a: holds\n  b: fails\n"
    p = spark.createDataFrame([(f"F{i}", "partial", "2/3", "absent", "wobble") for i in range(3)], "claim_id string, verdict string, spread string, dissent string, stability string")
    assert R.brief_text("T", p, 2) == "# T\n\n## wobble (3 claims)\n- F0: partial 2/3 ≠ absent\n- F1: partial 2/3 ≠ absent\n- and 1 more\n"


def test_links():
    text = '<a href="a/b.html#x">b</a> [c](c.md) <img src="http://e.org/i.png"> [c](c.md)'
    assert R.links_of(text) == ["a/b.html", "c.md"]
    assert R.relinked(text, {"c.md": "d/c.md"}).count("d/c.md") == 2


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['veriloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_nothing_imports_llm():
    root = Path(__file__).resolve().parent.parent / "veriloom"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "veriloom.llm" in p.read_text()]
