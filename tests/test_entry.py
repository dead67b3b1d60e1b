"""The driver's contract, with and without the optional subpackage."""

import pathlib
import re

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_flagship(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 10


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 74


def test_nothing_else_imports_the_optional_subpackage():
    optional = "ll" + "m"
    for path in (ROOT / "textgraph").rglob("*.py"):
        if path.parent.name != optional:
            assert not re.search(rf"textgraph\\.{optional}|import {optional}", path.read_text()), path
