"""The README names every query without SQL."""

from pathlib import Path

import __spark_entry__ as registry


def test_queries_without_sql_are_listed():
    text = (Path(registry.__file__).parent / "README.md").read_text()
    listed = text[text.index("### Left out") : text.index("## Corpus operators")]
    without = {n for n in set(registry.queries()) - set(registry.oracle_sql()) if not n.startswith("op")}
    assert all(f"`{n}`" in listed for n in without)
