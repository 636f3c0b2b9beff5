"""The native operations run no Python: neither in their result's plan nor in the tables that they write on the way."""

import pytest

from marketloom.llm import mixing, quality, templates
from tests.llm.cases import documents


@pytest.mark.parametrize("run", [mixing.mix_plan, mixing.mix, templates.drop_template_lines, quality.quality_verdicts, quality.keep_good], ids=lambda f: f.__name__)
def test_native(spark, run, monkeypatch):
    from marketloom import session
    from marketloom.functions import scale

    seen = []

    def spy(df, tag="step"):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return session.materialize(df, tag)

    for module in (mixing, quality, templates, scale):
        monkeypatch.setattr(module, "materialize", spy)
    out = run(documents(spark, plain=5)[1])
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(seen) > 1
    assert not any(word in text for text in seen for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
