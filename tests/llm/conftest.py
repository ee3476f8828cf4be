import pytest

pytest.importorskip("ledgerloom.llm")
