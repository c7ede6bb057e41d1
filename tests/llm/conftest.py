import pytest

pytest.importorskip("quillspark.llm")
